"""Documents to tokens in five stages: quality rules, near-duplicates, benchmark passages, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the columns of
documents; the last returns a row of token counts and digests for each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmend.llm import bpe, pii, quality_rules, simhash, tiling
from textmend.llm.common import checkpoint, table, without
from textmend.llm.queries import PII_SECRET, VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    verdicts = quality_rules.apply_rules(docs)
    return without(docs, checkpoint(verdicts.where(~F.col("kept")).select("doc_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of documents of a similarity of 0.8 on five-word shingles; rows that
    share an id are one document and stay together. Null and empty texts are one group; rows without an id stay."""
    groups = simhash.similar_documents(docs)
    return without(docs, checkpoint(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return tiling.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; n_chars counts the new text."""
    return pii.replace(docs, PII_SECRET).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY))
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=False)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("surrogates", surrogates), ("encoding", encoding)]
#: Most stages are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
