"""Blanks, likelihoods and pairs of penalties against plain Python."""

import math

from pyspark.sql import functions as F

from textmend.operators import blanks as B
from textmend.operators import language_model as LM


def test_places(spark):
    rows = [(0, "a b"), (1, ""), (2, None), (3, "\U0001f600c"), (4, " ")]
    got = {(r.i, r.k, r.blank): r.near for r in B.places(spark.createDataFrame(rows, "i int, t string"), ["i"], "t").collect()}
    want = {}
    for i, t in rows:
        if t is None:
            continue
        s = "\x02\x02" + t + "\x03\x03\x03"
        for k in range(len(t) + 1):
            want[i, k, False] = s[k : k + 4]
            if t[k : k + 1] == " ":
                want[i, k, True] = s[k : k + 2] + s[k + 3 : k + 5]
    assert got == want


def test_blank_probabilities(spark):
    texts = ["the cat sat", "the dog sat", "thecat"]
    counted = B.triples(spark.createDataFrame([(t,) for t in texts], "text string"))
    padded = ["\x02\x02" + t + "\x03\x03" for t in texts]
    n = lambda g: sum(p.startswith(g, i) for p in padded for i in range(len(p) - 2) if len(g) == 3)
    left = lambda g: sum(p[i : i + 2] == g for p in padded for i in range(len(p) - 2))
    right = lambda g: sum(p[i + 1 : i + 3] == g for p in padded for i in range(len(p) - 2))
    share = lambda c, of: (c + 1 / 256) / (of + 1)
    near = spark.createDataFrame([("heca",), ("zzzz",), ("heca",)], "near string")
    got = {r.near: r for r in B.blank_probabilities(near, counted).collect()}
    assert set(got) == {"heca", "zzzz"}
    for w, r in got.items():
        f, b, fn, bn = share(n(w[:2] + " "), left(w[:2])), share(n(" " + w[2:]), right(w[2:])), share(n(w[:3]), left(w[:2])), share(n(w[1:]), right(w[2:]))
        assert math.isclose(r.multiply, f * b) and math.isclose(r.average, (f + b) / 2)
        assert math.isclose(r.multiply_compared, f * b / (f * b + fn * bn)) and math.isclose(r.multiply_compared_min, f * b * (1 - fn * bn))
        assert math.isclose(r.average_compared, (f + b) / (f + b + fn + bn))
    changes = B.likely_changes(spark.createDataFrame([(7, "thecat"), (8, "the cat")], "id int, text string"), "id", counted).collect()
    assert {(r.id, r.k, r.blank) for r in changes if r.p > 0.5} >= {(7, 3, False)} and sum(r.blank for r in changes) == 1


def test_likelihoods_equal_the_model_in_a_task(spark):
    counted = LM.counts(spark.createDataFrame([("abab abc",), ("cab",)], "text string"))
    model = LM.Model({r.gram: r.cnt for r in counted.collect()})
    asked = ["abab", "zzzz", "ab c", "\x02\x02\x02c", "abcd", "abab"]
    got = {r.gram: r.p for r in LM.likelihoods(spark.createDataFrame([(a,) for a in asked], "gram string"), counted).collect()}
    assert set(got) == set(asked) and all(math.isclose(math.log(p), model.log_p(g[:3], g[3]), rel_tol=1e-9) for g, p in got.items())
    none = LM.likelihoods(spark.createDataFrame([("abcd",)], "gram string"), counted.where("false")).first()
    assert math.isclose(none.p, 1 / 256)


def test_best_pair_is_the_best_of_all(spark):
    cases = [(f"w{i % 7}", i % 3 == 0, i % 2 == 0, 1 + i % 5) for i in range(42)]
    scores = [(f"w{i}", k, (i - 3) * 0.7 + k) for i in range(7) for k in (0, 1)]
    got = B.best_pair(spark.createDataFrame(cases, "near string, o boolean, c boolean, cnt long"), spark.createDataFrame(scores, "near string, ahead int, score double")).collect()
    assert len(got) == 2
    for r in got:
        of = {w: s for w, k, s in scores if k == r.ahead}
        due, best = sum(n for _, o, c, n in cases if o != c), None
        for i in range(B.MOST + 1):
            for d in range(B.MOST + 1):
                hit = [(o != c, n) for w, o, c, n in cases if math.floor(10 * (-of[w] if c else of[w]) + 1e-9) >= (d if c else i) and (d if c else i) < B.MOST]
                tp, fp = sum(n for ok, n in hit if ok), sum(n for ok, n in hit if not ok)
                best = max(best or (0.0,), (2 * tp / (tp + fp + due), tp, fp))
        assert math.isclose(r.f1, best[0]) and r.fn == due - r.tp
    empty = B.best_pair(spark.createDataFrame([], "near string, o boolean, c boolean, cnt long"), spark.createDataFrame(scores, "near string, ahead int, score double"))
    assert empty.count() == 0


def test_changes_by_line_equal_those_of_places(spark, monkeypatch):
    """The surroundings of a chunk's places are asked for once each."""
    monkeypatch.setattr(B, "CHUNK", 40)
    texts = ["", " ", "ab a  b", "the cat sat", "thecat s at", "𝒳 é𝒳é", None, *["ab ba a b" * k for k in range(1, 5)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq_id long, text string")
    counted = B.triples(spark.createDataFrame([("the cat sat ab ba",), ("a b ab",)], "text string")).localCheckpoint()
    want: dict = {}
    for r in B.likely_changes(rows, "seq_id", counted).collect():
        want.setdefault(r.seq_id, []).extend([(r.k, r.blank)] if r.p >= 0.6 else [])
    got = {r.seq_id: r for r in B.changes_by_line(rows, "seq_id", counted, 0.6).collect()}
    assert set(got) == set(want)
    for key, made in want.items():
        assert got[key].changes == ",".join(f"{k}{'-' if b else '+'}" for k, b in sorted(made))
        assert (got[key].n_insert, got[key].n_delete) == (sum(not b for _, b in made), sum(b for _, b in made))
