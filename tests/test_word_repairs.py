"""Word counts in arrays and repairs of many texts against the plain versions."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from textmend.functions import batches
from textmend.functions import text as T
from textmend.operators import lookup, rules, search, stats
from textmend.plans import search as plans

ODD = ["", " ", "a\tb  c", "\t\tx\r\ny z", "½ 3²b_c ñandú 𝒳𝒴 1٣", "don't (a) [b] c", " é é"]


def test_counts_in_arrays_equal_those_of_rows(spark, monkeypatch):
    monkeypatch.setattr(stats, "TOGETHER", 20)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab1 ,\t é") for _ in range(rng.randrange(20))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {tuple(r) for r in stats.token_counts(rows).collect()} == {(r.token, r.cnt) for r in stats.merged_unigrams(stats.unigrams(rows)).collect()}
    assert {tuple(r) for r in stats.pair_counts(rows).collect()} == {(f"{r.left} {r.right}", r.cnt) for r in stats.bigrams(rows).collect()}


def test_rules_in_batches_equal_the_columns(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab1 2   .,\"-()'s½一\r") for _ in range(rng.randrange(14))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", rules.postprocess(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == batches.postprocess(pa.array([r.t for r in got])).to_pylist()


def test_many_texts_are_repaired_as_each():
    rng = random.Random(4)
    words = [w for w in ("a", "b", "ab", "ba", "aab", "abb", "bab", "abab", "1", "a-b") for _ in range(2)]
    for _ in range(60):
        uni = {w: rng.randrange(1, 9) for w in set(words) if rng.random() < 0.7}
        bi = {(x, y): rng.randrange(1, 9) for x in uni for y in uni if rng.random() < 0.3}
        texts = ["", " ", "a  b"] + [" ".join(rng.choice(words) + rng.choice(["", "", rng.choice(words)]) for _ in range(rng.randrange(12))) for _ in range(30)]
        for many, one in ((search.left_to_right_many, search.left_to_right), (search.unigram_corrector_many, search.unigram_corrector), (search.bigram_postprocess_many, search.bigram_postprocess)):
            assert many(uni, bi, 99, texts) == [one(uni, bi, t) for t in texts]
        assert search.window_fixer_many(uni, bi, 99, texts) == [search.window_fixer(uni, 99, t) for t in texts]


def test_pairs_that_no_repair_asks_for_are_not_counted(spark):
    rows = spark.createDataFrame([("the cat the re",)], "text string")
    asked = spark.createDataFrame([("the catthe re",)], "corrupt string")
    u = stats.token_counts(rows)
    assert {r.key for r in stats.pair_counts(rows, plans.made_up(asked, "corrupt", u, 3, 4)).collect()} == {"cat the"}


def test_chunks_of_few_bytes_stay_apart(spark):
    """What is done with a chunk takes long, so that small ones are not put into one task."""
    rows = lookup.dealt(spark.range(400).select("id", F.lit("a b").alias("text")), "id", 40 * lookup.CHARACTERS)
    spoken = lookup.repaired(rows, "text", spark.createDataFrame([], "chunk long, key string, cnt long"), lambda known: lookup.each(str.upper))
    assert spoken.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert spoken.where("predicted = 'A B'").count() == 400
