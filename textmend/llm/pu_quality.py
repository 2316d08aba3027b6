"""Quality classifier from positive and unlabelled documents.

Trusted positives and all texts as unlabelled web text give the non-negative unbiased risk: with class prior p,
p * R_pos(+) + max(0, R_unl(-) - p * R_pos(-)). For the squared loss and a model linear in its basis every part is a
quadratic form in moments of the basis, so one distributed pass over all documents gives all the risk needs; nothing is
sampled. The minimum is exact: the unbiased risk's, or, where its negative part falls below zero, the saddle point at
which that part is zero. The prior is estimated from the same moments: it is the inverse of the mean, over positives, of
the least-squares ratio of positive to unlabelled density.

The basis is steps of a dozen text ratios (case, digits, symbols, punctuation, word lengths, repetition), so the score
does not depend on the words of a language. Labels, languages, sources and ids are no inputs of it.

Edge cases: null and empty texts have all ratios zero and get a score like any other; without positives every score is
0.5; labels of unknown or null ids are ignored, repeated labels count once; repeated rows yield repeated result rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmend.llm.common import checkpoint, id_and_text, small_side

CUTS, RIDGE = (0.01, 0.04, 0.1, 0.2, 0.35, 0.55, 0.8), 1e-4
RATIOS = ("upper", "digits", "symbols", "pipes", "marks", "other", "word_length", "long_words", "repeated_words", "repeated_pairs", "top_word", "repeated_lines", "words")


@cache
def _classes() -> np.ndarray:
    """Class of each code point: 1 lower, 2 upper, 3 other letters, 4 digits, 5 white space, 6 usual marks, 7 ! and ?, 8 |, 9 other symbols."""

    def one(c: str) -> int:
        k = unicodedata.category(c)
        if k in ("Ll", "Lu"):
            return 1 + (k == "Lu")
        if k[0] in "LM":
            return 3
        if k[0] == "N":
            return 4
        if c.isspace():
            return 5
        return 6 if c in ".,;:'\"-()’“”«»" else 7 if c in "!?¡¿" else 8 if c == "|" else 9

    return np.fromiter(map(one, map(chr, range(0x110000))), np.uint8, 0x110000)


def ratios(text: str) -> list[float]:
    """Numbers from 0 to 1 that describe a text."""
    counts = np.bincount(_classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=10).tolist()
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text) - counts[5])
    often = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    letters = max(1, counts[1] + counts[2] + counts[3])
    return [
        counts[2] / letters, counts[4] / chars, counts[9] / chars * 3, counts[8] / n, counts[7] / chars * 3, (counts[3] + counts[6]) / chars, min(1.0, chars / n / 20), sum(map(len, filter(lambda w: len(w) > 14, often))) / chars,
        1 - len(often) / n, 1 - len(set(zip(words, words[1:]))) / max(1, n - 1), max(often.values(), default=0) / n, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, np.log1p(len(words)) / 12),
    ]


def basis(x: np.ndarray) -> np.ndarray:
    """A constant, the ratios, and a step at each cut."""
    return np.concatenate([np.ones((len(x), 1)), x, *[(x > c).astype(np.float64) for c in CUTS]], axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.num_columns - len(RATIOS) + i).to_numpy(zero_copy_only=False) for i in range(len(RATIOS))], axis=1).astype(np.float64)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one column per ratio)"""
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([ratios(t.as_py()) for t in batch.column(1)], np.float32).reshape(-1, len(RATIOS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, i]) for i in range(len(RATIOS))]], names=["id", *RATIOS])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{r} float" for r in RATIOS))


def moments(rows: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, mean of the basis, mean of its products: each task sends its sums, Spark adds them by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                b = basis(_matrix(batch))
                total = total + b.T @ b
        if not np.isscalar(total):
            at = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at[0]), dtype=np.int32)), pa.array(total[at])], names=["at", "total"])

    sums = rows.select(*RATIOS).mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    size = 1 + len(RATIOS) * (1 + len(CUTS))
    out = np.zeros((size, size))
    upper = np.triu_indices(size)
    for r in sums:
        out[upper[0][r["at"]], upper[1][r["at"]]] = r["total"]
    out = np.maximum(out, out.T)  # sums of non-negative numbers: the empty half is zero
    n = out[0, 0]
    return n, out[0] / max(n, 1), out / max(n, 1)


def estimate_prior(mean_pos: np.ndarray, prod_unl: np.ndarray, ridge: float = RIDGE) -> float:
    ratio = np.linalg.solve(prod_unl + ridge * np.eye(len(prod_unl)), mean_pos)
    return float(np.clip(1 / max(1e-9, ratio @ mean_pos), 0.01, 0.99))


def risk_parts(w, prior, mean_pos, prod_pos, mean_unl, prod_unl) -> tuple[float, float]:
    """The positive risk p * R_pos(+), and the negative part R_unl(-) - p * R_pos(-)."""
    square = lambda mean, prod, sign: (1 + sign * 2 * w @ mean + w @ prod @ w) / 4
    return prior * square(mean_pos, prod_pos, -1), square(mean_unl, prod_unl, 1) - prior * square(mean_pos, prod_pos, 1)


def fit(mean_pos, prod_pos, mean_unl, prod_unl, prior: float, ridge: float = RIDGE) -> np.ndarray:
    """Weights of least non-negative risk: max(0, g) is the largest s * g for s in [0, 1], so look for the s at which g is 0."""

    def at(s: float) -> np.ndarray:
        a = prior * (1 - s) * prod_pos + s * prod_unl + ridge * np.eye(len(prod_unl))
        return np.linalg.solve(a, prior * (1 + s) * mean_pos - s * mean_unl)

    negative = lambda s: risk_parts(at(s), prior, mean_pos, prod_pos, mean_unl, prod_unl)[1]
    if negative(1.0) >= 0:
        return at(1.0)
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if negative(middle) >= 0 else (low, middle)
    return at(low)


def score(docs: DataFrame, positives: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row of docs. positives: one column, ids of documents known to be good."""
    rows = checkpoint(features(docs, id_col, text_col))
    good = checkpoint(positives.toDF("_good").where("_good is not null").distinct())
    n_unl, mean_unl, prod_unl = moments(rows)
    n_pos, mean_pos, prod_pos = moments(rows.join(small_side(good), rows["id"] == good["_good"], "left_semi"))
    if n_pos:
        prior = estimate_prior(mean_pos, prod_unl) if prior is None else prior
        weights = fit(mean_pos, prod_pos, mean_unl, prod_unl, prior)
    else:
        weights = np.zeros(len(mean_unl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.clip((basis(_matrix(batch)) @ weights + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['id']}, score double")


def held_out(id_col: str = "doc_id"):
    """The rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
