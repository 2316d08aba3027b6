"""Queries on aligned texts: what scanners mistook, and how spelling repairs score. SQL has no such alignments; tests compare
the functions with brute force."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmend.functions import align as A
from textmend.functions import spaces as SP
from textmend.functions.batches import pieces
from textmend.operators import evaluate as E
from textmend.operators import noise as N
from textmend.plans.corpus import lines

QUERIES = {}
_PAIRS = "array<struct<wrong:string,right:string>>"


def query(f):
    QUERIES[f.__name__] = f
    return f


def scanned(spark, sf_dir) -> DataFrame:
    """Lines and what a poor scan makes of them."""
    return lines(spark, sf_dir).select("seq_id", "lang", F.col("text").alias("clean"), N.of_batches(F.col("text"), F.col("seq_id"), 0.1, 41, N.misread).alias("raw"))


def error_pairs(spark, sf_dir) -> DataFrame:
    """(seq_id, lang, wrong, right) of stretches of tokens that differ."""
    found = A.udf_of(lambda raw, clean: [{"wrong": x, "right": y} for x, y in A.ocr_errors(raw, clean)], _PAIRS)
    return scanned(spark, sf_dir).select("seq_id", "lang", F.inline(found("raw", "clean")))


@query
def ocr_error_frequencies(spark, sf_dir):
    """What tokens were mistaken for what, how often."""
    return error_pairs(spark, sf_dir).groupBy("wrong", "right").agg(F.count("*").alias("n"))


@query
def character_error_frequencies(spark, sf_dir):
    """What characters were mistaken for what: differing stretches of the mistaken tokens, each pair of tokens aligned once."""
    edits = A.udf_of(lambda x, y: [{"wrong": a, "right": b} for a, b in A.character_edits(x, y)], _PAIRS)
    counted = error_pairs(spark, sf_dir).groupBy("wrong", "right").agg(F.count("*").alias("cnt"))
    return counted.select("cnt", F.inline(edits("wrong", "right"))).groupBy("wrong", "right").agg(F.sum("cnt").alias("n"))


@query
def errors_per_token_length(spark, sf_dir):
    """Mistaken tokens by their length and number of edits."""
    pairs = error_pairs(spark, sf_dir)
    return pairs.groupBy(F.length("right").alias("length"), F.levenshtein("wrong", "right").alias("edits")).agg(F.count("*").alias("n"))


@query
def span_error_rates(spark, sf_dir):
    """By language: stretches of wrong tokens, their mean number of tokens, and edits a character."""
    pairs = error_pairs(spark, sf_dir)
    tokens = F.size(F.split("right", " "))
    return pairs.groupBy("lang").agg(F.count("*").alias("n_spans"), F.round(F.avg(tokens), 6).alias("mean_tokens"), F.round(F.sum(F.levenshtein("wrong", "right")) / F.sum(F.length("right")), 6).alias("rate"))


@query
def tolerant_evaluation(spark, sf_dir):
    """Scores of rules on lines with typing errors and space errors, the characters that misspelling put in left out of account."""
    from textmend.operators import rules as R

    rows = lines(spark, sf_dir).select("seq_id", "lang", F.col("text").alias("original"), N.of_batches(F.col("text"), F.col("seq_id"), 0.1, 43, N.mistyped).alias("correct"))
    rows = rows.withColumn("corrupt", SP.corrupt(F.col("correct"), F.col("seq_id"), 0.03, 0.15, 44)).withColumn("predicted", R.character_rules(F.col("corrupt")))
    names = ("correct", "corrupt", "predicted")

    def run(*columns: pa.Array) -> pa.Array:
        texts, made = [c.to_pylist() for c in columns], [[] for _ in names]
        for a, b in pieces(texts[0]):
            for part, done in zip(A.tolerants(*[t[a:b] for t in texts]), made, strict=True):
                done += part
        return pa.StructArray.from_arrays([pa.array(m, pa.string()) for m in made], names=list(names))

    three = F.arrow_udf(run, ", ".join(f"{n} string" for n in names))
    rows = rows.select("seq_id", "lang", three("original", *names).alias("t")).select("seq_id", "lang", "t.*")  # lines have no null texts
    out = E.summary(E.error_counts(rows, ["seq_id", "lang"]), ["lang"])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])
