"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.operators.lineage import checkpoint, shared_folder  # noqa: F401 - the operators take checkpoint from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, so that no other column's name can clash; a null text counts as empty."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Rows up to which a table of a few numbers a row is broadcast; beyond, Spark joins by a shuffle.
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame) -> DataFrame:
    """A materialised table of narrow rows, with a broadcast hint only if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs whose id is not among ids (a materialised one-column table); null ids stay."""
    ids = ids.toDF("_gone").distinct()
    return docs.join(small_side(ids), docs[id_col] == ids["_gone"], "left_anti")


def let(value, use):
    """use(value) with value worked out once: a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Spark's setting: what a query has shuffled is removed at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the folder of ``checkpoint``: smaller than a checkpoint where rows are many and narrow. What was
    shuffled for it is removed once it is written, so that an operator of several rounds holds one round's shuffle."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{uuid.uuid4()}", spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)
