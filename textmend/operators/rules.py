"""Rule-based repair of spaces, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmend.functions.arrays import let
from textmend.functions.batches import NO_SPACE_AFTER, NO_SPACE_BEFORE

#: Fixed value: what sticks to both neighbours.
NO_SPACE_AROUND = " "


def character_rules(text: Column) -> Column:
    """No space before , . ) nor between digits; one after , (but before digits) and ;, and before (."""
    text = F.regexp_replace(text, r" ([,.)])", "$1")
    for _ in range(2):  # the middle one of three digits belongs to two pairs
        text = F.regexp_replace(text, "([0-9]) ([0-9])", "$1$2")
    text = F.regexp_replace(text, r",([^ 0-9])", ", $1")
    return F.regexp_replace(F.regexp_replace(text, r"([^ (])\(", "$1 ("), r";([^ ])", "; $1")


def postprocess(text: Column) -> Column:
    """Snippets between spaces are joined or not, from left to right: marks stick to the word before, brackets to the word
    after, digits to digits, quotation marks in turn to the word after and the word before, hyphens between letters to both."""
    begin = F.struct(F.lit("").alias("out"), F.lit(True).alias("glue"), F.lit(0).alias("quotes"))

    def step(a: Column, x: Column) -> Column:
        s = x["s"]
        quote, last = s == '"', F.right(a["out"], F.lit(1))
        closing = quote & (a["quotes"] % 2 == 1)
        hyphen = (s == "-") & last.rlike(r"^\p{L}$") & x["next"].rlike(r"^\p{L}")
        before = s.isin(NO_SPACE_BEFORE) | closing | hyphen | (s.rlike(r"^\p{N}+$") & last.rlike(r"^\p{N}$")) | (s == NO_SPACE_AROUND)
        after = s.isin(NO_SPACE_AFTER) | (quote & ~closing) | hyphen | (s == NO_SPACE_AROUND)
        return F.struct(F.concat(a["out"], F.when(a["glue"] | before, s).otherwise(F.concat(F.lit(" "), s))).alias("out"), after.alias("glue"), (a["quotes"] + quote.cast("int")).alias("quotes"))

    paired = let(F.split(text, " "), lambda snippets: F.transform(snippets, lambda s, i: F.struct(s.alias("s"), F.coalesce(F.get(snippets, i + 1), F.lit("")).alias("next"))))
    return F.aggregate(paired, begin, step, lambda a: a["out"])
