"""Noise from tables: choices, changes that do not overlap, shares within sampling error, spans, rates by quantile."""

import math
import random

from pyspark.sql import functions as F

from textmend.operators import edits as D
from textmend.operators import span_noise as SN
from textmend.operators import table_noise as TN

EDITS = "array<struct<at:int,size:int,new:string>>"


def test_changes_settle_from_left_to_right(spark):
    rnd, rows, want = random.Random(3), [], []
    for i in range(60):
        n = rnd.randint(0, 40)
        text = "".join(rnd.choice("abé𝒳 ") for _ in range(n))
        made = sorted((at, min(rnd.randint(0, 3), n - at), rnd.choice(["", "x", "yz"])) for at in rnd.sample(range(n + 1), rnd.randint(0, n + 1)))
        out, cursor, kept = "", 0, 0
        for at, size, new in made:
            if at >= cursor:
                out, cursor, kept = out + text[cursor:at] + new, at + size, kept + 1
        rows.append((i, text, made))
        want.append((i, out + text[cursor:], kept))
    df = spark.createDataFrame(rows, f"i int, text string, e {EDITS}").withColumn("e", D.settled(F.col("e")))
    got = df.select("i", D.applied(F.split("text", ""), F.col("e")), F.size("e")).orderBy("i").collect()
    assert [tuple(r) for r in got] == want


def test_choices_add_up_and_skip_nulls(spark):
    table = spark.createDataFrame([("a", "x", 2), ("a", "y", 3), ("a", "x", 1), ("a", None, 5), (None, "z", 5), ("a", "w", 0), ("b", "q", 7)], "k string, v string, w long")
    found = D.choices(table, "k", "v", "w")
    assert {(r.key, tuple(r["values"]), tuple(r.ends), r.total) for r in found.collect()} == {("a", ("x", "y"), (3, 6), 6), ("b", ("q",), (7,), 7)}
    got = found.where("key = 'a'").select(*[D.chosen(F.col("values"), F.col("ends"), F.lit(x)) for x in (0.0, 2.9, 3.0, 5.9, None)]).first()
    assert tuple(got) == ("x", "x", "y", "y", None)


def test_weighted_errors_come_by_frequency(spark):
    """Errors of one, two and three characters are pooled by frequency; one goes on behind what it replaced."""
    table = spark.createDataFrame([("A", "a", 30), ("4", "a", 10), ("AB", "ab", 20), ("ABC", "abc", 40), ("-", "", 1), ("a b", "a", 10**6), ("long", "abcd", 10**6), (None, "a", 10**6)], "wrong string, correct string, freq long")
    rows = spark.range(4000).select(F.col("id").alias("seq_id"), F.lit("abc").alias("text"))
    got = TN.weighted_errors(rows, table, 0.999999, 0.0, 5).groupBy("noisy").count().collect()
    share = {r.noisy: r["count"] / 4000 for r in got}
    assert set(share) == {"Abc", "4bc", "ABc", "ABC"}  # b and c have no errors of their own
    for noisy, p in {"Abc": 0.3, "4bc": 0.1, "ABc": 0.2, "ABC": 0.4}.items():
        assert abs(share[noisy] - p) < 5 * math.sqrt(p * (1 - p) / 4000)


def test_an_end_takes_insertions_only(spark):
    table = spark.createDataFrame([("-", "", 1)], "wrong string, correct string, freq long")
    rows = spark.createDataFrame([(1, "ab  c"), (2, ""), (3, None)], "seq_id long, text string")
    got = {r.seq_id: (r.noisy, r.n_edits) for r in TN.weighted_errors(rows, table, 1.0, 1.0, 5).collect()}
    assert got == {1: ("-a-b-  -c-", 5), 2: ("", 0), 3: (None, 0)}
    assert {r.noisy for r in TN.weighted_errors(rows, table.limit(0), 1.0, 0.5, 5).collect()} == {"ab  c", "", None}


def test_misspellings_draw_apart_and_spread(spark):
    table = spark.createDataFrame([("the", "teh", 3), ("the", "hte", 1)], "correct string, misspelling string, freq long")
    rows = spark.range(50).select(F.col("id").alias("seq_id"), F.array_join(F.array_repeat(F.lit("the"), 80), " ").alias("text"))
    words = TN.misspellings(rows, table, 1.0, 0.0, 9).select(F.explode(F.split("noisy", " ")).alias("w")).groupBy("w").count().collect()
    count = {r.w: r["count"] for r in words}
    assert set(count) == {"teh", "hte"} and abs(count["teh"] / 4000 - 0.75) < 0.035
    few = spark.createDataFrame([(1, "the  cat"), (2, ""), (3, None)], "seq_id long, text string")
    assert {r.seq_id: r.noisy for r in TN.misspellings(few, table, 0.0, 0.5, 9).collect()} == {1: "the  cat", 2: "", 3: None}
    salts = D.with_choices(rows.select("seq_id", F.lit("the").alias("k")), D.choices(table, "correct", "misspelling", "freq"), "k", "t", F.col("seq_id"))
    assert salts.count() == 50 and salts.where("t_total = 4").count() == 50


def test_masks_fit_the_text(spark):
    rows = spark.range(300).select(F.col("id").alias("seq_id"), F.lit("a quick brown  fox é𝒳").alias("text"))
    for r in rows.select(TN.masked_typos(F.col("text"), F.col("seq_id"), 0.5, 4).alias("m")).collect():
        text, mask, n = r.m
        assert len(text) == len(mask) and all(mask[i] == "1" for i, c in enumerate(text) if c == " ")
        touched = [set(m) for m in ("".join(k if c != " " else " " for c, k in zip(text, mask))).split(" ")]
        assert sum(t == {"0"} for t in touched) <= n and not any(t == {"0", "1"} for t in touched)
    assert rows.limit(1).select(TN.masked_typos(F.lit(None).cast("string"), F.lit(1).cast("long"), 0.5, 4).alias("m")).first().m is None


def test_scanner_errors_keep_spaces(spark):
    rows = spark.range(200).select(F.col("id").alias("seq_id"), F.lit("from ff tail").alias("text"))
    for r in rows.select(TN.scanner_errors(F.col("text"), F.col("seq_id"), 0.9, 6).alias("e")).select(D.settled(F.col("e")).alias("e")).collect():
        assert all(e.size == 0 for e in r.e if e.at in (4, 7)) and all(a.at + a.size <= b.at for a, b in zip(r.e, r.e[1:]))


def test_spans_have_five_to_ten_tokens(spark):
    ends = spark.range(1, 400).select("id", SN.span_ends(F.col("id"), F.col("id") * 977).alias("e")).collect()
    for r in ends:
        sizes = [b - a for a, b in zip([0] + r.e, r.e)]
        assert r.e[-1] == r.id and all(5 <= s <= 10 for s in sizes[:-1]) and 1 <= sizes[-1] <= 10


def test_rates_by_quantile(spark):
    grid = SN.gamma_quantiles(1.0, 2.0)  # an exponential distribution
    assert all(abs(g + 2 * math.log(1 - k / 256)) < 1e-9 for k, g in enumerate(grid[:256]))
    us = [0.0, 0.1, 0.5, 0.9]
    got = spark.createDataFrame([(u,) for u in us], "u double").select(SN.from_quantiles(grid, F.col("u"))).collect()
    assert all(abs(r[0] + 2 * math.log(1 - u)) < 1e-3 for u, r in zip(us, got))
    law = SN.fitted_power_law(spark.range(20000).select(F.pow((F.col("id") + 0.5) / 20000, F.lit(1 / 0.7)).alias("x")).unionAll(spark.createDataFrame([(0.0,)] * 5000 + [(None,), (3.0,)], "x double")), "x").first()
    assert abs(law.exponent - 0.7) < 0.01 and law.p_zero == 0.2
    assert tuple(SN.fitted_power_law(spark.createDataFrame([], "x double"), "x").first()) == (None, 1.0)


def test_span_noise_moves_spaces_only(spark):
    text = "one two three four five six seven  eight nine ten eleven twelve"
    rows = spark.createDataFrame([(i, text) for i in range(100)] + [(200, ""), (201, None), (202, "x")], "seq_id long, text string")
    for r in SN.fitted_spans(rows, lambda u, v: u, 3).collect():
        assert r.text is None and r.noisy is None or r.noisy.replace(" ", "") == r.text.replace(" ", "")
    assert all(r.noisy == r.text for r in SN.fitted_spans(rows, lambda u, v: F.lit(0.0), 3).collect())
    rates = spark.createDataFrame([(3, 0.0, 1.0)], "n_tokens int, p_insert double, p_delete double")
    for r in SN.empirical_spans(rows.where("seq_id < 100"), rates, 3, p=0.2).collect():
        joined = [w for w in r.noisy.split(" ") if w not in text.split(" ")]
        assert r.noisy.replace(" ", "") == text.replace(" ", "") and len(joined) <= r.n_spans
    assert {(r.noisy, r.n_spans) for r in SN.empirical_spans(rows.where("seq_id >= 200"), rates.limit(0), 3, p=1.0).collect()} == {("", 0), (None, None), ("x", 0)}
