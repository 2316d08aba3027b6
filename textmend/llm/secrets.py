"""Secret scan: patterns, and a battery of randomness tests.

Three patterns give the base spans. The battery adds spans of kind ``random``: long tokens whose encoding is inferred and
which pass two things. First, neither the alphabet's uniformity (chi-squared), nor the runs above and below the
alphabet's middle, nor the correlation of neighbours tells the token from random symbols of its encoding: three times
the smallest of the three p-values is at least ``LEVEL``, so one in a hundred random tokens is lost. Second, the token
is a discovery against ordinary text: under that hypothesis at most ``TEXT_SWITCH`` of neighbours change between small
letters, capitals and digits (a capital before a small letter is no change), and letters are as frequent as in text; the
chance of so many changes, or of so rare letters, is the token's p-value. Over the tokens of a document the
Benjamini-Hochberg rule, weighted by length as long tokens give more evidence, holds the share of ordinary tokens among
what is reported to ``RATE``. Digits alone never differ from text and are not reported.

Built-in functions only: no Python runs on the executors, nothing is shuffled; work grows as n log n with the number of
spans of a text.

Edge cases: null texts count as empty and have no spans; spans are code point offsets, end exclusive; matches of a kind
are leftmost and do not overlap, those that are too short use up their text and are dropped; random spans never overlap
base spans; repeated rows yield repeated result rows; ties of p-values are reported together or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmend.functions.arrays import let, running_max, running_sums
from textmend.llm.common import id_and_text

#: Fixed by the contract: kind, pattern, least length (of the value for assign, else of the match).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 6), ("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]{24,}", 24)]
TOKEN, RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}", "random"
RATE, LEVEL = 0.05, 0.01
#: Ordinary text: most changes of character class a pair, mean and spread of the frequency of a letter's kind, and the
#: frequencies of a to z in percent.
TEXT_SWITCH, TEXT_MEAN, TEXT_SPREAD = 0.2, 6.55, 4.0
FREQUENCIES = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074]
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of all matches: what stands between matches tells where they are."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        ends = running_sums(F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["matches"])), m["matches"], lambda gap, x: F.length(gap) + F.length(x)))
        return F.zip_with(ends, m["matches"], lambda e, x: F.struct((e - F.length(x)).cast("int").alias("start"), e.cast("int").alias("end"), x.alias("match")))

    return let(F.struct(gaps.alias("gaps"), matches.alias("matches")), placed)


def found(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), spans(text, pattern)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def base_spans(text: Column, kind: str, pattern: str, least: int) -> Column:
    counted = (lambda m: F.length(F.regexp_extract(m, pattern, 2))) if kind == "assign" else F.length
    return F.filter(found(text, pattern), lambda s: counted(s["match"]) >= least)


def alphabet(token: Column) -> Column:
    """The symbols of the inferred encoding in order: the smallest alphabet that has all of the token's; null if none has."""
    body = F.regexp_replace(token, "=+$", "")
    return (
        F.when(body.rlike("^[0-9]+$"), _DIGITS).when(body.rlike("^[0-9a-f]+$"), _DIGITS + "abcdef").when(body.rlike("^[0-9A-F]+$"), _DIGITS + "ABCDEF")
        .when(body.rlike("^[a-z]+$"), _LOWER).when(body.rlike("^[A-Z]+$"), _UPPER).when(body.rlike("^[A-Z2-7]+$"), _UPPER + "234567")
        .when(body.rlike("^[0-9a-z]+$"), _DIGITS + _LOWER).when(body.rlike("^[0-9A-Z]+$"), _DIGITS + _UPPER).when(body.rlike("^[A-Za-z]+$"), _UPPER + _LOWER)
        .when(body.rlike("^[0-9A-Za-z]+$"), _DIGITS + _UPPER + _LOWER).when(body.rlike("^[0-9A-Za-z+/]+$"), _UPPER + _LOWER + _DIGITS + "+/")
        .when(body.rlike("^[0-9A-Za-z_-]+$"), _UPPER + _LOWER + _DIGITS + "-_")
    )


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, to about 1e-4."""
    return F.lit(1.0) / (1 + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def p_value(token: Column) -> Column:
    """Chance that a random string of the token's encoding looks as odd; null without an encoding."""

    def battery(t: Column) -> Column:
        x, size = t["x"], t["size"].cast("double")
        n = F.size(x).cast("double")
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), 2))
        freedom = size - 1
        chi = F.greatest(size / n * squares - n, F.lit(0.0))
        cube = (F.pow(chi / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
        high = F.transform(x, lambda v: (v >= size / 2).cast("int"))

        def runs(h: Column) -> Column:
            n1 = F.aggregate(h, F.lit(0.0), lambda a, v: a + v)
            n2 = n - n1
            changes = F.aggregate(F.sequence(F.lit(1), F.size(h) - 1), F.lit(1.0), lambda a, i: a + (F.get(h, i) != F.get(h, i - 1)).cast("double"))
            mean = 2 * n1 * n2 / n + 1
            spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
            return F.abs(changes - mean) / spread

        average = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n

        def serial(m: Column) -> Column:
            square = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
            product = F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda a, i: a + (F.get(x, i) - m) * (F.get(x, i - 1) - m))
            return F.abs((product / F.greatest(square, F.lit(1e-9)) + 1 / n) * F.sqrt(n))

        return F.least(F.lit(1.0), 3 * F.least(_tail(cube), 2 * _tail(let(high, runs)), 2 * _tail(let(average, serial))))

    codes = lambda a: F.transform(F.split(F.regexp_replace(token, "=+$", ""), ""), lambda c: F.instr(a, c) - 1)
    return let(alphabet(token), lambda a: F.when(a.isNotNull(), let(F.struct(codes(a).alias("x"), F.length(a).alias("size")), battery)))


def text_p_value(token: Column) -> Column:
    """Chance that an ordinary token changes so often between classes of characters, or has so rare letters."""
    kinds = F.split(F.translate(F.translate(F.translate(token, _LOWER, "a" * 26), _UPPER, "A" * 26), _DIGITS, "0" * 10), "")
    letters = F.split(F.regexp_replace(F.lower(token), "[^a-z]", ""), "")

    def switches(k: Column) -> Column:
        n = F.size(k) - 1.0
        change = lambda a, b: (a != b) & F.concat(a, b).isin("aA", "a0", "A0", "0a", "0A")
        count = F.aggregate(F.sequence(F.lit(1), F.size(k) - 1), F.lit(0.0), lambda s, i: s + change(F.get(k, i - 1), F.get(k, i)).cast("double"))
        return _tail((count - 0.5 - n * TEXT_SWITCH) / F.sqrt(n * TEXT_SWITCH * (1 - TEXT_SWITCH)))

    def rareness(x: Column) -> Column:
        table = F.array(*[F.lit(f) for f in FREQUENCIES])
        mean = F.aggregate(x, F.lit(0.0), lambda s, c: s + F.get(table, F.ascii(c) - 97)) / F.size(x)
        return _tail((F.lit(TEXT_MEAN) - mean) / TEXT_SPREAD * F.sqrt(F.size(x).cast("double")))

    rare = let(F.filter(letters, lambda c: c != ""), lambda x: F.when(F.size(x) > 0, rareness(x)).otherwise(1.0))
    return F.least(F.lit(1.0), 2 * F.least(let(kinds, switches), rare))


def apart(candidates: Column, base: Column) -> Column:
    """The candidates that touch no base span: of the base spans that begin before a candidate's end, the furthest end is
    looked at, along both in order."""
    events = F.sort_array(F.concat(
        F.transform(candidates, lambda c: F.struct(c["end"].alias("at"), F.lit(0).alias("is_base"), c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"))),
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_base"), b["start"].alias("start"), b["end"].alias("end"), F.lit("").alias("match")))))

    def free(e: Column) -> Column:
        reach = running_max(F.transform(e, lambda x: F.when(x["is_base"] == 1, x["end"]).otherwise(0)))
        marked = F.zip_with(e, reach, lambda x, r: F.struct(x.alias("x"), r.alias("reach")))
        kept = F.filter(marked, lambda m: (m["x"]["is_base"] == 0) & (m["reach"] <= m["x"]["start"]))
        return F.transform(kept, lambda m: F.struct(m["x"]["start"].alias("start"), m["x"]["end"].alias("end"), m["x"]["match"].alias("match")))

    return let(events, free)


def random_spans(text: Column, base: Column, rate: float = RATE, level: float = LEVEL) -> Column:
    """Candidates that do not touch base spans, are not told from random ones, and are discoveries against text."""

    def discovered(c: Column) -> Column:
        mean = F.aggregate(c, F.lit(0.0), lambda a, x: a + x["n"]) / F.size(c)
        weighted = F.transform(c, lambda x: F.struct((x["p_text"] * mean / x["n"]).alias("q"), x["start"].alias("start"), x["end"].alias("end"), x["p"].alias("p")))

        def up_to_bound(w: Column) -> Column:
            m = F.size(w)
            last = F.aggregate(F.sequence(F.lit(1), m), F.lit(-1.0), lambda a, k: F.when(F.get(w, k - 1)["q"] <= k * rate / m, F.get(w, k - 1)["q"]).otherwise(a))
            return let(last, lambda bound: F.transform(F.filter(w, lambda x: (x["q"] <= bound) & (x["p"] >= level)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

        return let(F.sort_array(weighted), up_to_bound)

    judged = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(s["match"]).alias("n"), p_value(s["match"]).alias("p"), text_p_value(s["match"]).alias("p_text"))
    scored = F.filter(F.transform(apart(found(text, TOKEN), base), judged), lambda x: x["p"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int>>")
    return let(scored, lambda c: F.when(F.size(c) > 0, discovered(c)).otherwise(none))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, all): arrays of struct<start, rank, end, kind> by start, then kind; one row per input row."""
    rows = id_and_text(docs, id_col, text_col)
    ranked = lambda spans, rank, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.sort_array(F.concat(*[ranked(base_spans(F.col("text"), *kind), k, kind[0]) for k, kind in enumerate(KINDS)]))
    rows = rows.select("id", "text", base.alias("base"))
    added = F.when(F.col("text").rlike(TOKEN), ranked(random_spans(F.col("text"), F.col("base")), len(KINDS), RANDOM))
    return rows.select(F.col("id").alias("doc_id"), "base", F.when(added.isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", added))).alias("all"))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
