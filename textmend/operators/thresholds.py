"""Thresholds fitted on predictions that come in rounds, where a later one can take a false one back.

``state_in_chunks`` works through all rounds of a chunk's gaps in arrays, so that no gap is a row; ``neighbourhoods`` to
``state_of`` do the same on rows of gaps, for predictions of any origin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmend.functions import batches
from textmend.functions import spaces as SP
from textmend.functions.arrays import let
from textmend.operators import labeling
from textmend.operators.evaluate import with_scores
from textmend.operators.lineage import checkpoint

UNKNOWN = 0.2
#: Characters of a context on each side of a gap; what the gaps before and behind are, each of: no space, a space, not there.
WIDTH, AROUND = (2, 2), 9


def neighbourhoods(rows: DataFrame, keep: list[str], text: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """(keep, k, context, gap, extra): a row for each gap between two characters: up to two characters on each side, whether there is a
    space, and what arrays of gaps in extra say there."""
    arrays = {"gap": SP.gaps(text)} | (extra or {})
    parts = F.struct(F.split(SP.merged(text), "").alias("chars"), *[F.transform(a, lambda n: n > 0).alias(n) for n, a in arrays.items()])

    def one(m: Column) -> Column:
        left = lambda k: F.array_join(F.slice(m["chars"], F.greatest(k - 1, F.lit(1)), F.least(k, F.lit(2))), "")
        right = lambda k: F.array_join(F.slice(m["chars"], k + 1, F.lit(2)), "")
        return F.transform(F.sequence(F.lit(1), F.size(m["chars"]) - 1), lambda k: F.struct(k.alias("k"), F.concat_ws("|", left(k), right(k)).alias("context"), *[F.get(m[n], k).alias(n) for n in arrays]))

    return rows.where(F.length(SP.merged(text)) > 1).select(*keep, F.inline(let(parts, one)))


def with_neighbours(gaps: DataFrame, key: str) -> DataFrame:
    """gaps (key, k, context, gap) with around: whether the gaps before and behind have a space now."""
    w = Window.partitionBy(key).orderBy("k")
    sign = lambda c: F.coalesce(c.cast("int"), F.lit(2)).cast("string")
    return gaps.withColumn("around", F.concat(sign(F.lag("gap").over(w)), sign(F.lead("gap").over(w))))


def shares(gaps: DataFrame, key: str) -> DataFrame:
    """(context, around, p): how likely a space is, smoothed, of gaps of true texts."""
    return with_neighbours(gaps, key).groupBy("context", "around").agg(((F.sum(F.col("gap").cast("int")) + 0.2) / (F.count("*") + 1.0)).alias("p"))


def predictions(gaps: DataFrame, model: DataFrame, key: str, rounds: int, threshold: float = 0.5) -> DataFrame:
    """(key, k, round, insertion, p): what each round changes. All gaps whose likeliest state, given their neighbours' states
    after the round before, is another one with at least the threshold change at once. Each round is cut off from the one
    before; rounds end when nothing changes."""
    now, made = checkpoint(gaps.select(key, "k", "context", "gap")), None
    for r in range(rounds):
        p = F.coalesce("p", F.lit(UNKNOWN))
        sure = F.when(F.col("gap"), 1 - p).otherwise(p)
        after = checkpoint(with_neighbours(now, key).join(model, ["context", "around"], "left").select(key, "k", "context", "gap", sure.alias("p"), (sure >= threshold).alias("changed")))
        changes = after.where("changed").select(key, "k", F.lit(r).alias("round"), (~F.col("gap")).alias("insertion"), "p")
        made = changes if made is None else made.unionAll(changes)
        if after.where("changed").isEmpty():
            break
        now = after.select(key, "k", "context", (F.col("gap") != F.col("changed")).alias("gap"))
    return made


def labelled(predicted: DataFrame, truth: DataFrame, key: str, place: str = "k") -> DataFrame:
    """(key, p, tp, fp, fn): each prediction in its order. It is a true positive if the truth (key, place, insertion) has it and no
    prediction before took it; else, if its inverse is an unrepaired false positive of that place, it takes that one back: fp = -1; else
    it is a false positive. What the truth has and none predicts is a false negative with p = -1."""
    said = predicted.groupBy(key, place).agg(F.sort_array(F.collect_list(F.struct("round", "insertion", "p"))).alias("said"))
    due = truth.groupBy(key, place).agg(F.max(F.col("insertion").cast("int")).alias("_i"), F.max((~F.col("insertion")).cast("int")).alias("_d"))
    both = said.join(due, [key, place], "full")
    case = lambda p, tp, fp, fn: F.struct(p.alias("p"), F.lit(tp).alias("tp"), F.lit(fp).alias("fp"), F.lit(fn).alias("fn"))
    open_ = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    begin = F.struct(open_("_i").alias("due_i"), open_("_d").alias("due_d"), F.lit(False).alias("false_i"), F.lit(False).alias("false_d"), F.slice(F.array(case(F.lit(0.0), 0, 0, 0)), 1, 0).alias("cases"))

    def add(a: Column, s: Column) -> Column:
        ins = s["insertion"]
        true = F.when(ins, a["due_i"]).otherwise(a["due_d"])
        back = ~true & F.when(ins, a["false_d"]).otherwise(a["false_i"])
        false = ~true & ~back
        label = F.when(true, case(s["p"], 1, 0, 0)).when(back, case(s["p"], 0, -1, 0)).otherwise(case(s["p"], 0, 1, 0))
        return F.struct((a["due_i"] & ~(true & ins)).alias("due_i"), (a["due_d"] & ~(true & ~ins)).alias("due_d"), ((a["false_i"] | (false & ins)) & ~(back & ~ins)).alias("false_i"),
                        ((a["false_d"] | (false & ~ins)) & ~(back & ins)).alias("false_d"), F.concat(a["cases"], F.array(label)).alias("cases"))

    def end(a: Column) -> Column:
        missed = F.array_repeat(case(F.lit(-1.0), 0, 0, 1), a["due_i"].cast("int") + a["due_d"].cast("int"))
        return F.concat(a["cases"], missed)

    said_or_none = F.coalesce("said", F.slice(F.array(F.struct(F.lit(0).alias("round"), F.lit(False).alias("insertion"), F.lit(0.0).alias("p"))), 1, 0))
    return both.select(key, F.inline(F.aggregate(said_or_none, begin, add, end)))


def state_of(sequences: DataFrame, cases: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """(key, t, tp, fp, fn): a sequence's sums of each cut score, and a row of nothing that says it is done."""
    t = F.when(F.col("p") < 0, -1.0).otherwise(F.floor(F.col("p") * 10**digits) / F.lit(float(10**digits)))
    sums = cases.groupBy(key, t.alias("t")).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    done = sequences.select(key, F.lit(-1.0).alias("t"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return sums.unionAll(done)


def around(gap: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The number of what each gap's neighbours of the same text are now. gap: whether there is a space, text by text."""
    same = text[1:] == text[:-1]
    before, behind = np.full(len(gap), 2), np.full(len(gap), 2)
    before[1:][same], behind[:-1][same] = gap[:-1][same], gap[1:][same]
    return 3 * before + behind


def shares_around(rows: DataFrame, text: str) -> DataFrame:
    """(context, p_space array<double>): ``shares`` of true texts, by the number of ``around``; null where it was not seen. The gaps are
    counted where they are; what is shuffled is a row for each case that a task has met."""
    names = ["context", "around", "space", "cnt"]

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in batches.pieces(texts, labeling.COUNTED):
                flat, gap, place, sizes = labeling.gap_arrays(texts[a:b])
                left, at = np.repeat(sizes, sizes) - place, np.flatnonzero(place > 0)
                space = (gap[at] > 0).astype(np.int64)
                near = around(space, np.repeat(np.arange(len(sizes)), sizes)[at])
                first, _, count = labeling.context_numbers(flat, place, left, at, [near, space], WIDTH)
                near, space, at = near[first], space[first], at[first]
                contexts = [labeling.context_at(flat, *q, WIDTH) for q in zip(at.tolist(), place[at].tolist(), left[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(contexts, pa.string()), pa.array(near, pa.int32()), pa.array(space, pa.int64()), pa.array(count, pa.int64())], names=names)

    counted = rows.select(text).mapInArrow(run, "context string, around int, space bigint, cnt bigint")
    sums = [F.sum(F.when(F.col("around") == k, n)) for k in range(AROUND) for n in (F.col("cnt"), F.col("cnt") * F.col("space"))]
    summed = counted.groupBy("context").agg(*[s.alias(f"_{i}") for i, s in enumerate(sums)])
    return summed.select("context", F.array(*[(F.col(f"_{2 * k + 1}") + 0.2) / (F.col(f"_{2 * k}") + 1.0) for k in range(AROUND)]).alias("p_space"))


def cases_in_rounds(text: np.ndarray, o: np.ndarray, gap: np.ndarray, p: np.ndarray, rounds: int, threshold: float = 0.5) -> tuple[np.ndarray, ...]:
    """text, p, tp, fp and fn of each case: ``labelled`` of ``predictions``. text: the number of each gap's text; o, gap: whether there is a space
    in the true text and now; p: of a space, by the number of ``around``."""
    now, made, out = gap.copy(), np.zeros(len(gap), np.int64), []
    due = o != gap
    for _ in range(rounds):
        likely = p[np.arange(len(p)), around(now, text)]
        likely = np.where(np.isnan(likely), UNKNOWN, likely)
        sure = np.where(now, 1 - likely, likely)
        at = np.flatnonzero(sure >= threshold)
        if not len(at):
            break
        made[at] += 1
        nth, wanted = made[at], due[at]
        true = wanted & (nth == 1)
        false = np.where(true, 0, np.where((nth % 2 == 1) == wanted, -1, 1))  # each change undoes the one before; the first of a due gap is true
        out.append((text[at], sure[at], true.astype(np.int64), false, np.zeros(len(at), np.int64)))
        now[at] = ~now[at]
    missed = text[due & (made == 0)]
    none = np.zeros(len(missed), np.int64)
    out.append((missed, np.full(len(missed), -1.0), none, none, none + 1))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def state_in_chunks(rows: DataFrame, model: DataFrame, true: str, corrupt: str, key: str, rounds: int, digits: int = 3) -> DataFrame:
    """``state_of`` the rows (key, true, corrupt) after some rounds by a model of ``shares_around``."""
    def use(keys: pa.ChunkedArray, text: np.ndarray, k: np.ndarray, o: np.ndarray, gap: np.ndarray, p: np.ndarray) -> pa.Table:
        text, p, *counts = cases_in_rounds(text, o > 0, gap > 0, p, rounds)
        cut = np.where(p < 0, -1, np.floor(p * 10**digits)).astype(np.int64)
        case, at = np.unique(text * (10**digits + 2) + cut + 1, return_inverse=True)
        text, cut = case // (10**digits + 2), case % (10**digits + 2) - 1
        sums = [pa.array(np.bincount(at, weights=c, minlength=len(case)).astype(np.int64)) for c in counts]
        return pa.table([keys.take(pa.array(text)), pa.array(np.where(cut < 0, -1.0, cut / float(10**digits))), *sums], names=[key, "t", "tp", "fp", "fn"])

    schema = f"{key} {dict(rows.dtypes)[key]}, t double, tp bigint, fp bigint, fn bigint"
    sums = labeling.by_context(rows, model, true, corrupt, key, use, schema, WIDTH, AROUND)
    return sums.unionAll(rows.select(key, F.lit(-1.0).alias("t"), *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "fn")]))


def resumed(path: str, sequences: DataFrame, cases_of, key: str = "seq_id") -> DataFrame:
    """The state in the folder path after all sequences: those that an earlier run has finished are not worked on again.
    cases_of: labelled cases of sequences. A run that is interrupted while it writes adds nothing."""
    spark = sequences.sparkSession
    try:
        todo = sequences.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = sequences
    todo = checkpoint(todo)
    state_of(todo, cases_of(todo), key).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def sweep(state: DataFrame) -> DataFrame:
    """(t, tp, fp, fn, precision, recall, f1) at each score: all predictions of at least it are made. The window runs over the
    scores' different values."""
    binned = state.groupBy("t").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    w, every = Window.orderBy(F.desc("t")), Window.partitionBy()
    due = F.sum(F.col("tp") + F.col("fn")).over(every)
    summed = binned.select("t", F.sum("tp").over(w).alias("tp"), F.sum("fp").over(w).alias("fp"), (due - F.sum("tp").over(w)).alias("fn")).where("t >= 0")
    return with_scores(summed)


def best(swept: DataFrame) -> DataFrame:
    """The row of the best f1, of the highest score among equals."""
    return swept.agg(F.max(F.struct("f1", "t", "precision", "recall", "tp", "fp", "fn")).alias("b")).where("b is not null").select("b.*")
