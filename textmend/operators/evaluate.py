"""Evaluation of repairs, and what follows from their counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textmend.functions import batches


def error_counts(rows: DataFrame, keep: list[str], true: str = "correct", corrupt: str = "corrupt", predicted: str = "predicted") -> DataFrame:
    """One row per sequence: tp, fp and fn by type, and is_correct. The texts differ in spaces only."""
    kept = rows.select(*keep, F.col(true).alias("_o"), F.col(corrupt).alias("_c"), F.col(predicted).alias("_p"))
    fields = [*kept.schema.fields[:-3], *[StructField(n, LongType()) for n in batches.COUNTS]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts = batches.error_counts(*part.columns[-3:])
            yield pa.RecordBatch.from_arrays([*part.columns[:-3], *counts.flatten()], names=[f.name for f in fields])

    # no UDF: Spark finds one again in a plan only if no lambda is among what it is given
    return judged(kept.mapInArrow(run, StructType(fields)))


def counter(keep: list[str], fix: Callable[[pa.Array], pa.Array] | None = None) -> Callable[[pa.Table], pa.Table]:
    """The columns kept and the COUNTS of a table of texts (correct, corrupt, predicted). fix: what the predicted ones go through before."""

    def use(rows: pa.Table) -> pa.Table:
        true, corrupt, predicted = (pa.array(rows.column(c).to_pylist(), pa.string()) for c in ("correct", "corrupt", "predicted"))
        counts = batches.error_counts(true, corrupt, fix(predicted) if fix else predicted)
        return pa.table([*[rows.column(c) for c in keep], *counts.flatten()], names=[*keep, *batches.COUNTS])

    return use


def judged(counts: DataFrame) -> DataFrame:
    """counts with is_correct."""
    wrong = F.col("fp_del") + F.col("fn_del") + F.col("fp_ins") + F.col("fn_ins")
    return counts.withColumn("is_correct", wrong == 0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def with_scores(totals: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp and fn; 0 where a denominator is 0."""
    out = totals.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(counts: DataFrame, by: list[str]) -> DataFrame:
    total = lambda k: F.sum(F.col(f"{k}_del") + F.col(f"{k}_ins")).alias(k)
    return with_scores(counts.groupBy(*by).agg(F.count("*").alias("n"), total("tp"), total("fp"), total("fn"), F.avg(F.col("is_correct").cast("double")).alias("sequence_accuracy")))


def threshold_sweep(cases: DataFrame, score: str = "p", label: str = "label", cnt: str = "cnt", digits: int | None = 3, by: list[str] | None = None) -> DataFrame:
    """(t, tp, fp, fn, f1) at each score that occurs, of counted cases: those of a score are added up first, so the window runs
    over the distinct scores, with ``digits`` (cut, not rounded) at most 10^digits of them. by: a sweep for each group."""
    by = by or []
    t = F.floor(F.col(score) * 10**digits) / F.lit(float(10**digits)) if digits else F.col(score)
    binned = cases.groupBy(*by, t.alias("t")).agg(F.sum(F.col(label) * F.col(cnt)).alias("pos"), F.sum((1 - F.col(label)) * F.col(cnt)).alias("neg"))
    w = Window.partitionBy(*by).orderBy(F.desc("t"))
    out = binned.select(*by, "t", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), (F.sum("pos").over(Window.partitionBy(*by)) - F.sum("pos").over(w)).alias("fn"))
    return with_scores(out)


def significance(bits: DataFrame, a: str, b: str, chunk: int = 4096) -> DataFrame:
    """(n_a, n_b, p): exact paired randomisation test of two 0/1 columns. If each of the n sequences that only one method
    has right is given to either with one half, the difference is at least as large as observed with probability p. The
    binomial tail is summed in chunks over all tasks; no window runs over its n terms: each chunk of factors gives a partial
    sum of logarithms, of which there are n / chunk, and each term starts from its chunk's."""
    n = bits.agg(F.sum(((F.col(a) == 1) & (F.col(b) == 0)).cast("long")).alias("n_a"), F.sum(((F.col(a) == 0) & (F.col(b) == 1)).cast("long")).alias("n_b"))
    n = n.select(F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).withColumn("n", F.col("n_a") + F.col("n_b"))
    first = lambda c: c * chunk  # noqa: E731 - a chunk's terms: log of binomial(n, k) for k from first(c)
    parts = n.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / chunk))).alias("c"))
    ratio_log = lambda k: F.log((F.col("n") - k + 1.0) / k)  # noqa: E731 - from binomial(n, k - 1) to binomial(n, k)
    ks = F.sequence(F.greatest(first(F.col("c")), F.lit(1)), F.least(first(F.col("c")) + chunk - 1, F.col("n")))
    terms = F.when(F.col("n") == 0, F.array().cast("array<double>")).otherwise(F.transform(ks, ratio_log))
    parts = parts.withColumn("steps", terms).withColumn("own", F.aggregate("steps", F.lit(0.0), lambda s, x: s + x))
    before = F.coalesce(F.sum("own").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = parts.select("c", before.alias("before"))  # n / chunk rows
    full = parts.join(starts, "c")
    begin = F.struct(F.col("before").alias("log"), F.greatest(first(F.col("c")), F.lit(1).cast("long")).alias("k"), F.lit(0.0).alias("p"))
    mass = lambda log: F.exp(log - F.col("n") * F.log(F.lit(2.0)))
    far = lambda k: F.abs(F.col("n") - 2 * k) >= F.abs(F.col("n_a") - F.col("n_b"))

    def add(s, x):
        log = s["log"] + x
        return F.struct(log.alias("log"), (s["k"] + 1).alias("k"), (s["p"] + F.when(far(s["k"]), mass(log)).otherwise(0.0)).alias("p"))

    tail = F.aggregate("steps", begin, add, lambda s: s["p"]) + F.when((F.col("c") == 0) & far(F.lit(0)), mass(F.lit(0.0))).otherwise(0.0)
    return full.groupBy("n_a", "n_b").agg(F.least(F.lit(1.0), F.sum(tail)).alias("p"))


SMOOTHING = 1e-6


def smoothed_summary(counts: DataFrame, by: list[str]) -> DataFrame:
    """Scores with smoothed denominators, 1 where there is nothing to find and nothing found: means of the sequences' scores
    (macro), and those of their sums (micro)."""
    tp, fp, fn = (F.col(f"{k}_del") + F.col(f"{k}_ins") for k in ("tp", "fp", "fn"))
    share = lambda a, b: (a + SMOOTHING) / (a + b + SMOOTHING)
    nothing = tp + fp + fn == 0
    rows = counts.select(*by, tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.when(nothing, 1.0).otherwise(share(tp, fp)).alias("p"), F.when(nothing, 1.0).otherwise(share(tp, fn)).alias("r"))
    f1 = lambda p, r: 2 * p * r / (p + r)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.avg(f1(F.col("p"), F.col("r"))).alias("macro_f1"),
                                share(F.sum("tp"), F.sum("fp")).alias("micro_precision"), share(F.sum("tp"), F.sum("fn")).alias("micro_recall"))
    return out.withColumn("micro_f1", f1(F.col("micro_precision"), F.col("micro_recall")))


def relative_improvement(baseline: Column, improved: Column) -> Column:
    return 1 - (1 - improved) / (1 - baseline)


def relative_log_improvement(baseline: Column, improved: Column, epsilon: float = 1e-6) -> Column:
    return 1 - F.log(improved + epsilon) / F.log(baseline + epsilon)


def fitted_distribution(rows: DataFrame, x: str, by: list[str]) -> DataFrame:
    """(by, shape, scale, pareto): a gamma distribution by mean and variance, a Pareto exponent by the mean logarithm."""
    mean, var = F.avg(x), F.var_samp(x)
    return rows.groupBy(*by).agg((mean * mean / var).alias("shape"), (var / mean).alias("scale"), (1 / F.avg(F.log(x))).alias("pareto"))


def without_inverse_pairs(rows: DataFrame, kinds: str = "kinds") -> DataFrame:
    """(place, type) of the repairs of each row: kinds has 1 for a deletion's repair, -1 for an insertion's, 0 for none at each
    place. A deletion's goes if the place before has an insertion's, and that one with it."""
    k = F.col(kinds)
    left = F.transform(k, lambda x, i: F.when((x == 1) & ((i == 0) | (F.get(k, i - 1) != -1)), F.struct(i.alias("place"), F.lit("DELETION").alias("type"))).when(
        (x == -1) & (F.coalesce(F.get(k, i + 1), F.lit(0)) != 1), F.struct(i.alias("place"), F.lit("INSERTION").alias("type"))))
    return rows.select(F.inline(F.filter(left, lambda x: x.isNotNull())))


def without_inverses(predictions: DataFrame, key: str) -> DataFrame:
    """predictions (key, position, type, ...) without those whose inverse, the other type at the same place, is predicted too.
    Repeated ones stay; a place's predictions meet in one window."""
    w = Window.partitionBy(key, "position")
    return predictions.withColumns({"_lo": F.min("type").over(w), "_hi": F.max("type").over(w)}).where(F.col("_lo") == F.col("_hi")).drop("_lo", "_hi")


def uncancelled(rows: DataFrame, key: str, true: str = "correct", corrupt: str = "corrupt", predicted: str = "predicted") -> DataFrame:
    """(key, position, type): by gap, the changes from the true to the corrupt text and from there to the predicted one, without those
    whose inverse stands in the same gap. All changes of a gap are in one row, so nothing is shuffled."""
    kept = rows.select(key, true, corrupt, predicted).dropna(subset=[true, corrupt, predicted])
    kinds = pa.array(["DELETION", "INSERTION"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            three = [c.to_pylist() for c in part.columns[1:]]
            for a, b in batches.pieces(three[0]):
                (o, ends), (c, same), (p, also) = [batches.gaps_of(t[a:b]) for t in three]
                if not (np.array_equal(ends, same) and np.array_equal(ends, also)):
                    raise ValueError("texts to compare differ in more than spaces")
                first, second = p != c, o != c  # what repair and what noise changed; more spaces than before are a DELETION
                cancelled = first & second & ((p > c) != (c > o))
                at, more = [np.concatenate(x) for x in zip(*[(k, m[k]) for k, m in ((np.flatnonzero(f & ~cancelled), m) for f, m in ((first, p > c), (second, c > o)))], strict=True)]
                row = np.searchsorted(ends, at, side="right")
                position = at - np.concatenate(([0], ends))[row]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(a + row)), pa.array(position, pa.int32()), kinds.take(pa.array(np.where(more, 0, 1)))], names=[key, "position", "type"])

    return kept.mapInArrow(run, f"{key} {dict(kept.dtypes)[key]}, position int, type string")


def benchmark_name(noise: Column, p: Column) -> Column:
    """Name of a benchmark: noise and share of errors with one decimal, 0 for no noise, 1 and inf as such."""
    share = F.when(p == float("inf"), "inf").when(p == 1, "1").otherwise(F.format_string("%.1f", p))
    return F.concat(F.when(noise > 0, F.format_string("%.1f", noise)).otherwise("0"), F.lit("_"), share)
