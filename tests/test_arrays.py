"""Running values against plain sums."""

from itertools import accumulate

from pyspark.sql import functions as F

from textmend.functions.arrays import running_max, running_sums


def test_running_values_equal_plain_ones(spark):
    rows = [([(k * 7919) % 23 - 5 for k in range(n)],) for n in (0, 1, 2, 255, 256, 257, 512, 513, 70_000)] + [(None,)]
    got = spark.createDataFrame(rows, "x array<int>").select("x", running_sums(F.col("x")).alias("s"), running_max(F.col("x")).alias("m")).collect()
    for r in got:
        assert (r.s, r.m) == ((None, None) if r.x is None else (list(accumulate(r.x)), list(accumulate(r.x, max))))
