"""Noise and counts of batches against plain Python."""

import math

from pyspark.sql import functions as F

from textmend.functions import batches
from textmend.functions import spaces as SP
from textmend.functions.rng import FACTOR, MODULUS, PRIMES
from tests.test_gaps import TEXTS, respaced


def plain(text, row, p_insert, p_delete, seed):
    mod = lambda x, m: int(math.fmod(x, m))  # noqa: E731 -- of the sign of x
    s = mod(mod(row, MODULUS) * PRIMES[0] + seed * 1_000_003 + 17, MODULUS)
    for _ in range(2):
        s = mod(s * (mod(s, PRIMES[1]) + 1), MODULUS)
    out = ""
    for i, c in enumerate(text):
        x = mod(s + (i + FACTOR) * PRIMES[3], MODULUS)
        u = mod(mod(x * (mod(x, PRIMES[1]) + 1), MODULUS) * PRIMES[2], MODULUS) / MODULUS
        if c == " ":
            out += "" if u < p_delete else " "
        else:
            out += " " + c if i and text[i - 1] != " " and u < p_insert else c
    return out


def test_noise_of_batches_with_rates_of_rows(spark):
    texts = TEXTS + ["one two  three " * 30, "long " * 40_000, None, "", " x"]
    rows = [(i * 1_000_003 - 2_000_000, t, (i % 4) / 4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i long, t string, p double").coalesce(1)
    got = df.select("i", "t", "p", SP.corrupt(F.col("t"), F.col("i"), F.col("p") / 5, F.col("p"), 35).alias("n")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n == (None if r.t is None else plain(r.t, r.i, r.p / 5, r.p, 35))


def test_pieces_do_not_change_results(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array([respaced(t, k) for k, t in enumerate(TEXTS)])
    seeds, p = pa.array(np.arange(len(TEXTS)) * 7919), pa.array([0.3] * len(TEXTS))
    whole = batches.corrupt(texts, seeds, p, p)
    counts = batches.error_counts(pa.array(TEXTS), texts, pa.array([t.replace(" ", "") for t in TEXTS]))
    monkeypatch.setattr(batches, "PIECE", 1)
    assert batches.corrupt(texts, seeds, p, p) == whole
    assert batches.error_counts(pa.array(TEXTS), texts, pa.array([t.replace(" ", "") for t in TEXTS])) == counts


def test_counts_of_null_texts_are_null(spark):
    df = spark.createDataFrame([(0, "a b", "ab", "a b"), (1, None, "ab", "ab")], "i int, o string, c string, p string")
    got = {r.i: r.n for r in df.select("i", SP.error_counts(F.col("o"), F.col("c"), F.col("p")).alias("n")).collect()}
    assert (got[0].tp_del, got[0].fp_ins) == (1, 0) and (got[1] is None or got[1].tp_del is None)
