"""Texts that differ in spaces only, compared gap by gap.

``gaps`` lists, for each character that is no space and for the end, how many spaces stand before it. Two texts with the
same characters are then two arrays of one length, and everything about their space errors is arithmetic on them: no
alignment search, no exploding; noise and error counts run on whole batches (``batches``). For a gap of o spaces in the true text and c in the corrupt one, whose first
space would stand at s in the corrupt text, equal spaces are matched first: o > c is a deletion at s + c, c > o are
insertions at s + o to s + c - 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textmend.functions import batches
from textmend.functions.arrays import let, sums_before
from textmend.functions.rng import row_seed


def gaps(text: Column) -> Column:
    """array<int>, one longer than the characters that are no spaces."""
    return F.transform(F.regexp_extract_all(F.concat(text, F.lit("$")), F.lit("( *)[^ ]"), F.lit(1)), F.length)


def merged(text: Column) -> Column:
    return F.translate(text, " ", "")


def spaced(characters: Column, gaps: Column) -> Column:
    """The text of given characters (no spaces) and gaps."""
    chars = F.split(F.concat(characters, F.lit("$")), "")
    return F.regexp_replace(F.array_join(F.zip_with(chars, gaps, lambda c, n: F.concat(F.repeat(F.lit(" "), n), c)), ""), r"\$$", "")


def differing(true: Column, corrupt: Column, use) -> Column:
    """use(array<struct<k, o, c, s>>) of the gaps that differ: s is where the gap's first space would stand in a text with
    the gaps ``corrupt``."""
    every = F.arrays_zip(F.sequence(F.lit(0), F.size(true) - 1).alias("k"), true.alias("o"), corrupt.alias("c"))

    def placed(m: Column) -> Column:
        before = sums_before(m["corrupt"], F.transform(m["odd"], lambda g: g["k"]))
        return F.zip_with(m["odd"], before, lambda g, n: F.struct(g["k"].alias("k"), g["o"].alias("o"), g["c"].alias("c"), (g["k"] + n).cast("int").alias("s")))

    odd = F.filter(every, lambda g: g["o"] != g["c"])
    return let(F.struct(odd.alias("odd"), corrupt.alias("corrupt")), lambda m: let(placed(m), use))


def corruptions(true: Column, corrupt: Column) -> Column:
    """array<struct<position, type>> in places of the corrupt text. true, corrupt: gaps."""
    typed = lambda p, kind: F.struct(p.alias("position"), F.lit(kind).alias("type"))

    def one(g: Column) -> Column:
        s, o, c = g["s"], g["o"], g["c"]
        return F.when(o > c, F.array(typed(s + c, "DELETION"))).otherwise(F.transform(F.sequence(s + o, s + c - 1), lambda p: typed(p, "INSERTION")))

    return differing(true, corrupt, lambda odd: F.flatten(F.transform(odd, one)))


def true_places(true: Column, corrupt: Column) -> Column:
    """array<struct<position, type>>, one for each gap that differs, in places of the true text. true, corrupt: gaps."""

    def one(g: Column) -> Column:  # the other way round: c is the true text's gap
        return F.struct((g["s"] + F.least(g["o"], g["c"])).alias("position"), F.when(g["c"] > g["o"], "DELETION").otherwise("INSERTION").alias("type"))

    return differing(corrupt, true, lambda odd: F.transform(odd, one))


def distance(a: Column, b: Column) -> Column:
    """Spaces to put in and take out to get from one text to the other, given their gaps."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x).cast("long")


def error_counts(true: Column, corrupt: Column, predicted: Column) -> Column:
    """Struct of tp, fp and fn of the predicted repairs, by type, each a sum over gaps. All three: texts with the same
    characters but for spaces."""
    counts = StructType([StructField(n, LongType()) for n in batches.COUNTS])
    return F.arrow_udf(batches.error_counts, counts)(true, corrupt, predicted)


def corrupt(text: Column, row: Column, p_insert: float | Column, p_delete: float | Column, seed: int) -> Column:
    """Each space goes with p_delete; before each character whose neighbour before it is no space, one comes with p_insert.
    text: a column without lambdas in it, which Spark would not tell apart."""
    share = lambda p: (p if isinstance(p, Column) else F.lit(p)).cast("double")
    return F.arrow_udf(batches.corrupt, StringType())(text, row_seed(seed, row), share(p_insert), share(p_delete))


def revert(text: Column, errors: Column) -> Column:
    """Undo corruptions on fixed places, in any order: spaces at INSERTIONs go, one comes before the character at each
    DELETION. The text is cut at the errors, so each character is copied once."""

    def sorted_codes(n: Column) -> Column:
        known = F.filter(errors, lambda e: e["type"].isin("INSERTION", "DELETION") & e["position"].between(0, n))
        return F.array_sort(F.array_distinct(F.transform(known, lambda e: e["position"] * 2 + (e["type"] == "INSERTION").cast("int"))))

    behind = lambda code: F.floor(code / 2).cast("int") + code % 2  # noqa: E731 -- what goes on after an error

    def cut(m: Column) -> Column:
        chars, codes = m["chars"], m["codes"]

        def piece(code: Column, j: Column) -> Column:
            begin = F.when(j == 0, F.lit(0)).otherwise(behind(F.get(codes, j - 1)))
            said = F.array_join(F.slice(chars, begin + 1, F.greatest(F.floor(code / 2).cast("int") - begin, F.lit(0))), "")
            return F.concat(said, F.when(code % 2 == 0, " ").otherwise(""))

        rest = F.slice(chars, F.coalesce(behind(F.try_element_at(codes, F.lit(-1))), F.lit(0)) + 1, F.size(chars))
        return F.concat(F.array_join(F.transform(codes, piece), ""), F.array_join(rest, ""))

    return let(F.struct(F.split(text, "").alias("chars"), F.coalesce(let(F.length(text), sorted_codes), F.array().cast("array<int>")).alias("codes")), cut)


def positions_in_merged(text: Column) -> Column:
    """Places, counted without spaces, that have a space before them (the end not included)."""
    return let(gaps(text), lambda g: F.filter(F.sequence(F.lit(0), F.size(g) - 2), lambda i: (F.size(g) > 1) & (F.get(g, i) > 0)))


def readable_differences(a: Column, b: Column, ignore_punctuation: bool = True) -> Column:
    """array<struct<a, b>>: places in both texts, equal but for spaces, where one has a space that the other lacks. If
    punctuation is ignored, spaces count only between two of 0-9 and a-z. What only one text has at its end is no difference."""
    chars = F.split(merged(a), "")

    def wanted(g: Column, letters: Column) -> Column:
        alone = (F.greatest(g["o"], g["c"]) == 1) & F.get(letters, g["k"] - 1).rlike("^[0-9a-z]$") & F.get(letters, g["k"]).rlike("^[0-9a-z]$")
        return (alone if ignore_punctuation else F.lit(True)) & (g["k"] < F.size(letters))

    def one(g: Column, e: Column) -> Column:
        at, most, least = g["k"] + e["n"], F.greatest(g["o"], g["c"]), F.least(g["o"], g["c"])
        spot = lambda t: F.struct((g["k"] + e["a"] + F.when(g["o"] > g["c"], t).otherwise(least)).cast("int").alias("a"), (at + F.when(g["o"] > g["c"], least).otherwise(t)).cast("int").alias("b"))
        return F.transform(F.sequence(least, most - 1), spot)

    def found(m: Column) -> Column:
        odd = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size(m["a"]) - 1).alias("k"), m["a"].alias("o"), m["b"].alias("c")), lambda g: g["o"] != g["c"])
        kept = F.filter(odd, lambda g: wanted(g, m["chars"]))
        at = lambda gs: F.transform(gs, lambda g: g["k"])
        ends = lambda gs: F.arrays_zip(sums_before(m["a"], at(gs)).alias("a"), sums_before(m["b"], at(gs)).alias("n"))
        return let(kept, lambda gs: F.flatten(F.zip_with(gs, ends(gs), one)))

    return F.when(merged(a) == "", F.array().cast("array<struct<a:int,b:int>>")).otherwise(let(F.struct(gaps(a).alias("a"), gaps(b).alias("b"), chars.alias("chars")), found))


def inverted(kind: Column) -> Column:
    """The type of the error that undoes one of this type."""
    return F.when(kind == "INSERTION", "DELETION").when(kind == "DELETION", "INSERTION")
