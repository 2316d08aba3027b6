"""Numbers of rows in an order of all rows, and two corpora dealt into each other, without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmend.operators.lineage import checkpoint


def numbered(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """rows with their place (from 0) in the order of all, which must be total. Rows are sorted in ranges, each range counted,
    and what is added to a range's places is a table of a row for each range. Written once, so that a lost task finds the same."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpoint(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    return ranged.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_before") + inside).drop("_id", "_part", "_before")


def interleaved(a: DataFrame, b: DataFrame, key: str, seed: int) -> DataFrame:
    """(first, key, n): rows of a (first) and b in one order in which each keeps its own by key, all mixtures being equally
    likely: each corpus has as many random numbers as rows, and its k-th row gets the k-th smallest. key: unique in each."""

    def dealt(df: DataFrame, first: bool) -> DataFrame:
        said = F.concat(F.lit(f"{seed}:{'a' if first else 'b'}:"), F.col(key).cast("string"))
        own = numbered(df.select(key), [F.col(key)], "k")
        drawn = numbered(df.select(F.md5(said).alias("place")), [F.col("place")], "k")
        return own.join(drawn, "k").select(F.lit(first).alias("first"), key, "place")

    both = dealt(a, True).unionAll(dealt(b, False))
    return numbered(both, [F.col("place"), F.col("first"), F.col(key)]).select("first", key, "n")
