"""Gaps, places of errors and their reversion against plain Python, on odd and very long texts."""

import random
import time

from pyspark.sql import functions as F

from textmend.functions import spaces as SP
from textmend.functions.arrays import sums_before
from textmend.operators import labeling as L

TEXTS = ["", " ", "a", "ab", " ab ", "a  b c", "\U0001f600 x\U0001f600y z", "tab\there", "ein  Haus, zwei", "x" * 700]


def respaced(text, seed):
    draw = random.Random(seed)
    return "".join(" " * draw.choice([0, 0, 0, 1, 2]) + c for c in text.replace(" ", "")) + " " * draw.choice([0, 1])


def pairs():
    return [(i, t, respaced(t, i)) for i, t in enumerate(TEXTS)]


def test_sums_before(spark):
    rows = [([3, 1, 4, 1, 5], [0, 2, 4]), ([], []), ([2] * 600, list(range(0, 600, 2))), ([7], [])]
    got = spark.createDataFrame(rows, "n array<int>, at array<int>").select("n", "at", sums_before(F.col("n"), F.col("at")).alias("s")).collect()
    assert all(r.s == [sum(r.n[:k]) for k in r.at] for r in got)


def test_corruptions_are_undone(spark):
    df = spark.createDataFrame(pairs(), "i int, o string, c string")
    errors = SP.corruptions(SP.gaps(F.col("o")), SP.gaps(F.col("c")))
    # a gap that lost several spaces gets one back, as a gap has one place
    got = df.select("i", "o", "c", errors.alias("e")).select("i", "o", "e", SP.revert(F.col("c"), F.col("e")).alias("back"), SP.revert(F.col("c"), F.reverse("e")).alias("again")).collect()
    for r in got:
        assert r.back == r.again
        if "  " not in r.o and r.o == r.o.strip():
            assert r.back == r.o


def test_revert_ignores_what_is_no_error(spark):
    e = "array<struct<position:int,type:string>>"
    rows = [("ab c", [(2, "INSERTION"), (2, "INSERTION"), (1, "DELETION"), (99, "DELETION"), (0, "OTHER")], "a bc"), ("ab", None, "ab"), ("ab", [], "ab"), ("ab", [(2, "DELETION")], "ab "), ("a b", [(1, "DELETION"), (1, "INSERTION")], "a b"), (None, [], None)]
    got = spark.createDataFrame(rows, f"t string, e {e}, want string").select("want", SP.revert(F.col("t"), F.col("e")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_gap_rows(spark):
    df = spark.createDataFrame([*pairs(), (99, None, None)], "i int, o string, c string")
    got = {(r.i, r.k): (r.context, r.gap, r.o) for r in L.gap_rows(df, F.col("c"), ["i"], {"o": SP.gaps(F.col("o"))}).collect()}
    want = {}
    for i, o, c in pairs():
        m = o.replace(" ", "")
        counted = lambda t: [len(x) for x in __import__("re").findall("( *)[^ ]", t)]
        for k in range(1, len(m)):
            want[i, k] = (m[max(k - 3, 0) : k] + "|" + m[k : k + 2], counted(c)[k], counted(o)[k])
    assert got == want


def test_a_very_long_line(spark):
    """64,000 characters: linear work, a few seconds each."""
    text = " ".join(["word", "an", "other"] * 5000)[:64000]
    df = spark.createDataFrame([(0, text, respaced(text, 1))], "i int, o string, c string").coalesce(1)
    began = time.time()
    assert L.gap_rows(df, F.col("c"), ["i"], {"o": SP.gaps(F.col("o"))}).agg(F.count("*"), F.max("context")).first()[0] == len(text.replace(" ", "")) - 1
    cut = time.time()
    errors = SP.corruptions(SP.gaps(F.col("o")), SP.gaps(F.col("c")))
    assert df.select("o", SP.revert(F.col("c"), errors).alias("back")).where("o = back").count() == 1
    assert cut - began < 15 and time.time() - cut < 15
