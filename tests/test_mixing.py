"""Numbers in an order of all rows, interleaving, differences that readers see, inverse predictions."""

import random
import re

from pyspark.sql import functions as F

from textmend.functions import spaces as SP
from textmend.operators import evaluate as E
from textmend.operators import mixing as M


def test_numbered(spark):
    words = ["b", "a", None, "c", "a", "", "zz"] * 40
    df = spark.createDataFrame(list(enumerate(words)), "id int, w string").repartition(7)
    got = {r.id: r.n for r in M.numbered(df, [F.col("w"), F.col("id")]).collect()}
    want = sorted(range(len(words)), key=lambda i: (words[i] is not None, words[i] or "", i))
    assert got == {i: n for n, i in enumerate(want)}
    assert M.numbered(df.where("false"), [F.col("id")]).count() == 0


def test_interleaved_keeps_both_orders(spark):
    a, b = spark.range(200).select(F.col("id")), spark.range(50).select((F.col("id") * 3).alias("id"))
    rows = sorted(M.interleaved(a, b, "id", 5).collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(250))
    for first, ids in ((True, list(range(200))), (False, [3 * i for i in range(50)])):
        assert [r.id for r in rows if r["first"] == first] == ids
    assert 5 < sum(not r["first"] for r in rows[:125]) < 45  # b's rows are all over
    assert M.interleaved(a, b.where("false"), "id", 5).count() == 200


def walked(a, b, ignore):
    out, i, j = [], 0, 0
    plain = lambda s, k: 0 <= k < len(s) and re.fullmatch("[0-9a-z]", s[k]) is not None
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        s, k = (a, i) if a[i] == " " else (b, j)
        if not ignore or (plain(s, k - 1) and plain(s, k + 1)):
            out.append((i, j))
        i, j = (i + 1, j) if s is a else (i, j + 1)
    return out


def test_readable_differences(spark):
    draw, rows = random.Random(3), [("", ""), ("  ", ""), ("a b", "ab "), (" ab", "ab"), ("a , b", "a,b"), ("a  b", "a b")]
    for _ in range(60):
        letters = [draw.choice("ab1,.Zé\U0001f600") for _ in range(draw.randint(1, 30))]
        rows.append(tuple("".join(" " * draw.choice([0, 0, 0, 1, 1, 2]) + c for c in letters) + " " * draw.choice([0, 1]) for _ in range(2)))
    df = spark.createDataFrame(rows, "a string, b string")
    for ignore in (True, False):
        for r in df.select("a", "b", SP.readable_differences(F.col("a"), F.col("b"), ignore).alias("d")).collect():
            assert [tuple(x) for x in r.d] == walked(r.a, r.b, ignore), (r.a, r.b)


def test_inverses_and_names(spark):
    rows = [(1, 3, "INSERTION"), (1, 3, "DELETION"), (1, 4, "DELETION"), (1, 4, "DELETION"), (2, 3, "INSERTION")]
    kept = E.without_inverses(spark.createDataFrame(rows, "k int, position int, type string"), "k")
    assert sorted(map(tuple, kept.collect())) == [(1, 4, "DELETION"), (1, 4, "DELETION"), (2, 3, "INSERTION")]
    back = kept.select(SP.inverted(F.col("type")).alias("t")).distinct().collect()
    assert {r.t for r in back} == {"INSERTION", "DELETION"}
    df = spark.createDataFrame([(0.0, 0.1), (0.1, 1.0), (0.2, float("inf")), (0.0, 0.5)], "n double, p double")
    assert [r.x for r in df.select(E.benchmark_name(F.col("n"), F.col("p")).alias("x")).collect()] == ["0_0.1", "0.1_1", "0.2_inf", "0_0.5"]
