"""Alignment of long lines, and noise of whole batches against expressions and row by row."""

import random
import time

from pyspark.sql import functions as F

from textmend.functions import align as A
from textmend.operators import noise as N


def test_a_long_line_is_aligned_in_seconds():
    rng = random.Random(1)
    clean = [str(rng.randrange(500)) for _ in range(12_000)]
    raw = [t + "x" if rng.random() < 0.1 else t for t in clean]
    begin = time.monotonic()
    pairs = A.common_pairs(raw, clean)
    assert time.monotonic() - begin < 15 and len(pairs) >= sum(x == y for x, y in zip(raw, clean, strict=True))
    assert all(raw[i] == clean[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert A.common_pairs(list("x"), list("xx")) == [(0, 1)] and A.common_pairs(list("ab"), list("ba")) == [(1, 0)]


def test_noise_of_batches_is_that_of_expressions(spark):
    texts = ["abcd\r efgh\x85 ij  li ab\r\n", "", None, " ", "the rn modern client hi", "éé \U0001f600ab \U0001d49cbc"]
    rows = spark.createDataFrame([(k - 5, texts[k % len(texts)]) for k in range(300)], "i bigint, t string").cache()
    for one, other in ((N.ocr_errors, N.misread), (N.typos, N.mistyped)):
        got = rows.select("i", N.of_batches(F.col("t"), F.col("i"), 0.4, 7, other)).collect()
        assert got == rows.select("i", one(F.col("t"), F.col("i"), 0.4, 7)).collect() and any(b != texts[(i + 5) % len(texts)] for i, b in got)
