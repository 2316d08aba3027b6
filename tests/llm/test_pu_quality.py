import numpy as np
import pytest
from pyspark.sql import functions as F

from textmend.llm import pu_quality as pu


def test_moments_equal_numpy_and_prior_is_found(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["plain", "words", "of", "good", "prose", "and", "more"], 40)) + f" {i}." for i in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(["buy", "now", "cheap"], 40)) for i in range(100)]
    rows = [(i, t, 1, "x") for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int, id string").repartition(7)
    n, mean, prod = pu.moments(pu.features(df))
    x = pu.basis(np.array([pu.ratios(t) for t in good + bad], np.float32).astype(np.float64))
    assert n == 400
    assert mean == pytest.approx(x.mean(axis=0)) and prod == pytest.approx(x.T @ x / 400)
    pos = x[:200]
    assert pu.estimate_prior(pos.mean(axis=0), prod) == pytest.approx(0.75, abs=0.05)
    trusted = df.where("doc_id < 200").select("doc_id")
    got = {r.doc_id: r.score for r in pu.score(df, trusted).collect()}
    assert all((got[i] >= 0.5) == (i < 300) for i in got) and len(got) == 400


def test_non_negative_risk_is_least(spark):
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(0.6, 0.3, (8, 3)), rng.normal(0.2, 0.5, (9, 3))
    parts = [f(z) for z in (pos, unl) for f in (lambda z: z.mean(axis=0), lambda z: z.T @ z / len(z))]
    risk = lambda w, prior: sum(max(0.0, v) if k else v for k, v in enumerate(pu.risk_parts(w, prior, *parts)))
    for prior in (0.3, 0.6, 0.9):
        w = pu.fit(*parts, prior, ridge=1e-9)
        assert all(risk(w, prior) <= risk(w + rng.normal(0, s, 3), prior) + 1e-7 for s in (0.001, 0.01, 0.1, 1) for _ in range(200))


def test_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "some text"), (3, "x" * 100_000)], "doc_id long, text string")
    assert [r.score for r in pu.score(df, df.where("false").select("doc_id")).collect()] == [0.5] * 5
    got = pu.score(df, spark.createDataFrame([(3,), (None,), (77,), (3,)], "doc_id long")).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert pu.score(df.where("false"), df.select("doc_id")).collect() == []


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = pu.score(docs, labels.where((F.col("quality") == 1) & ~pu.held_out()).select("doc_id"))
    tested = scored.join(labels, "doc_id").where(pu.held_out()).select(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int").alias("ok")).collect()
    assert len(tested) > 50 and np.mean([r.ok for r in tested]) >= 0.9
