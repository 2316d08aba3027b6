"""How likely a blank is at each place of a text, and penalties from what a model says some characters ahead. What is scored
are distinct surroundings of a place; positions are counted before they meet a model."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textmend.functions import spaces as SP
from textmend.functions.batches import SPACE, codes_of
from textmend.operators.language_model import END, START, likelihoods
from textmend.operators.lineage import checkpoint
from textmend.operators.lookup import dealt

#: Thresholds are tenths of a natural logarithm from 0 to MOST - 1 (all above are one); MOST stands for no change at all.
AHEAD, MOST = 3, 201
#: Characters of a chunk.
CHUNK = 1 << 20


def triples(rows: DataFrame, text: str = "text") -> DataFrame:
    """(gram, cnt): all windows of three characters of the padded rows, what blanks are learnt from."""
    padded = F.concat(F.lit(START * 2), F.col(text), F.lit(END * 2))
    cut = F.regexp_extract_all(padded, F.lit("(?s)(?=(.{3}))."), F.lit(1))
    return rows.select(F.explode(cut).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt"))


def places(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, k, blank, near): each place where a blank can come (blank false, k from 0 to the length) or is (blank true, k its
    place), with the two characters before and the two behind it. Null texts have no place, empty ones have one."""
    padded = F.concat(F.lit(START * 2), F.col(text), F.lit(END * 3))
    cut = F.regexp_extract_all(padded, F.lit("(?s)(?=(.{5}))."), F.lit(1))
    five = rows.select(*keep, F.posexplode(cut).alias("k", "five"))
    made = lambda blank, near: F.struct(F.lit(blank).alias("blank"), near.alias("near"))
    coming, there = made(False, F.substring("five", 1, 4)), made(True, F.concat(F.substring("five", 1, 2), F.substring("five", 4, 2)))
    return five.select(*keep, "k", F.inline(F.when(F.substring("five", 3, 1) == " ", F.array(coming, there)).otherwise(F.array(coming))))


def blank_probabilities(near: DataFrame, counted: DataFrame) -> DataFrame:
    """(near, average, multiply, average_compared, multiply_compared, multiply_compared_min) of distinct surroundings: a blank's
    probability after what stands before and before what stands behind, combined; compared: with both characters next to each
    other. counted: triples."""
    counted = checkpoint(counted)
    sums = {"left": F.substring("gram", 1, 2), "right": F.substring("gram", 2, 2)}
    out = near.select("near").distinct()
    a, b, c, d = (F.substring("near", i, 1) for i in (1, 2, 3, 4))
    for name, key in {"left": F.concat(a, b), "right": F.concat(c, d)}.items():
        out = out.withColumn("key", key).join(counted.groupBy(sums[name].alias("key")).agg(F.sum("cnt").alias(name)), "key", "left").drop("key")
    for name, key in {"left_blank": F.concat(a, b, F.lit(" ")), "right_blank": F.concat(F.lit(" "), c, d), "left_next": F.concat(a, b, c), "right_next": F.concat(b, c, d)}.items():
        out = out.withColumn("key", key).join(counted.select(F.col("gram").alias("key"), F.col("cnt").alias(name)), "key", "left").drop("key")
    p = lambda name, of: (F.coalesce(name, F.lit(0)) + 1 / 256) / (F.coalesce(of, F.lit(0)) + 1.0)
    out = out.select("near", p("left_blank", "left").alias("f"), p("right_blank", "right").alias("b"), p("left_next", "left").alias("fn"), p("right_next", "right").alias("bn"))
    both, mean, next_both, next_mean = F.col("f") * F.col("b"), (F.col("f") + F.col("b")) / 2, F.col("fn") * F.col("bn"), (F.col("fn") + F.col("bn")) / 2
    return out.select("near", mean.alias("average"), both.alias("multiply"), (mean / (mean + next_mean)).alias("average_compared"), (both / (both + next_both)).alias("multiply_compared"), (both * (1 - next_both)).alias("multiply_compared_min"))


def likely_changes(rows: DataFrame, key: str, counted: DataFrame, method: str = "multiply_compared", text: str = "text") -> DataFrame:
    """(key, k, blank, p): every place of each row with the probability of a change: of a blank that comes, or goes (blank)."""
    at = places(rows, [key], text)
    scored = blank_probabilities(at, counted).select("near", F.col(method).alias("p"))
    return at.join(scored, "near").select(key, "k", "blank", F.when(F.col("blank"), 1 - F.col("p")).otherwise(F.col("p")).alias("p"))


def near_numbers(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``places`` of texts in arrays: the padded texts' characters; the text, k, blank of each place; the number of its surroundings; a place of each number."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)  # places where a blank can come
    flat = "".join([START * 2 + t + END * 3 for t in texts])
    codes = codes_of(flat).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    k = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(text)) + 4 * text
    there = np.flatnonzero(codes[at + 2] == SPACE)
    order = np.argsort(np.concatenate((2 * np.arange(len(at)), 2 * there + 1)), kind="stable")
    blank = order >= len(at)
    of = np.concatenate((np.arange(len(at)), there))[order]
    at, behind = at[of], at[of] + 2 + blank
    halves = [np.unique(codes[x] * 0x110000 + codes[x + 1], return_inverse=True)[1] for x in (at, behind)]
    _, first, number = np.unique(halves[0] * (int(halves[1].max(initial=0)) + 1) + halves[1], return_index=True, return_inverse=True)
    return flat, text[of], k[of], blank, number, np.stack((at[first], behind[first]), axis=1)


def changes_by_line(rows: DataFrame, key: str, counted: DataFrame, least: float, method: str = "multiply_compared", text: str = "text", characters: int | None = None) -> DataFrame:
    """(key, n_insert, n_delete, changes): how many of ``likely_changes`` of each text have p >= least, and which, as "k+" and "k-" in order. Texts are
    dealt out to chunks, whose distinct surroundings meet the model and come back where they count; no place is shuffled. characters: about how many there are, where that is known."""
    texts = rows.select(key, F.col(text).alias("_text")).where("_text is not null")
    characters = texts.agg(F.sum(F.length("_text"))).first()[0] if characters is None else characters
    chunks = dealt(texts, key, characters or 0, CHUNK)

    def surroundings(mine: pa.Table):
        flat, *parts, firsts = near_numbers(mine.column("_text").to_pylist())
        return [flat[a : a + 2] + flat[b : b + 2] for a, b in firsts.tolist()], *parts

    def asked(mine: pa.Table) -> pa.Table:
        near = surroundings(mine)[0]
        return pa.table([pa.array([mine.column("chunk")[0].as_py()] * len(near), pa.int64()), pa.array(near, pa.string())], names=["chunk", "near"])

    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        near, line, k, blank, number = surroundings(mine)
        comes, goes = ({n for n, is_likely in zip(found.column("near").to_pylist(), found.column(c).to_pylist(), strict=True) if is_likely} for c in ("comes", "goes"))
        likely = np.array([[n in comes, n in goes] for n in near], np.bool_).reshape(-1, 2)
        made = np.flatnonzero(likely[number, blank.astype(np.int64)])
        line, blank = line[made], blank[made]
        n, n_delete = (np.bincount(x, minlength=mine.num_rows) for x in (line, line[blank]))
        said = [f"{a}-" if b else f"{a}+" for a, b in zip(k[made].tolist(), blank.tolist(), strict=True)]
        ends = np.cumsum(n).tolist()
        return pa.table([mine.column(key), pa.array(n - n_delete, pa.int64()), pa.array(n_delete, pa.int64()), pa.array([",".join(said[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.string())], names=[key, "n_insert", "n_delete", "changes"])

    wanted = checkpoint(chunks.select("chunk", "_text").groupBy("chunk").applyInArrow(lambda mine: asked(mine), "chunk bigint, near string"))
    scored = blank_probabilities(wanted, counted).select("near", (F.col(method) >= least).alias("comes"), (1 - F.col(method) >= least).alias("goes")).where("comes or goes")
    kept = [f for f in texts.schema.fields if f.name == key]
    fields = [*kept, StructField("n_insert", LongType()), StructField("n_delete", LongType()), StructField("changes", StringType())]
    return chunks.groupBy("chunk").cogroup(wanted.join(scored, "near").groupBy("chunk")).applyInArrow(lambda mine, found: run(mine, found), StructType(fields))


def ahead_cases(rows: DataFrame, true: str, corrupt: str) -> DataFrame:
    """(near, o, c, cnt): how many gaps between characters have three characters before and three behind them (in the true text
    with runs of spaces as one), a space in the true text (o) and in the corrupt one (c)."""
    said = F.trim(F.regexp_replace(true, " +", " "))
    padded = F.concat(F.lit(START * 3), said, F.lit(END * 3))
    cut = F.regexp_extract_all(padded, F.lit("(?s)(?=(.{2}[^ ] ?.{3}))."), F.lit(1))  # as many as there are gaps
    inner = lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 2, F.lit(0)))
    zipped = F.arrays_zip(inner(cut).alias("near"), inner(SP.gaps(F.col(true))).alias("o"), inner(SP.gaps(F.col(corrupt))).alias("c"))
    near = F.concat(F.substring("near", 1, 3), F.substring("near", -3, 3)).alias("near")
    return rows.select(F.inline(zipped)).groupBy(near, (F.col("o") > 0).alias("o"), (F.col("c") > 0).alias("c")).agg(F.count("*").alias("cnt"))


def ahead_scores(near: DataFrame, counted: DataFrame) -> DataFrame:
    """(near, ahead, score): for 0 to AHEAD characters behind a gap, the logarithm of how much likelier they are with a space in
    it, the space's own probability included. counted: grams of four characters."""
    part = lambda i, n: F.substring("near", i, n)
    grams = {
        "space": F.concat(part(1, 3), F.lit(" ")), "w1": F.concat(part(2, 2), F.lit(" "), part(4, 1)), "w2": F.concat(part(3, 1), F.lit(" "), part(4, 2)), "w3": F.concat(F.lit(" "), part(4, 3)),
        "n1": part(1, 4), "n2": part(2, 4), "n3": part(3, 4),
    }
    near = checkpoint(near.select("near").distinct())
    asked = near.select(F.explode(F.array(*grams.values())).alias("gram")).distinct()
    p = checkpoint(likelihoods(asked, counted))
    out = near
    for name, gram in grams.items():
        out = out.withColumn("gram", gram).join(p.select("gram", F.col("p").alias(name)), "gram").drop("gram")
    ratios, ratio = [], F.col("space")
    for k in range(AHEAD + 1):
        if k:
            ratio = ratio * F.col(f"w{k}") / F.col(f"n{k}")
        ratios.append(F.struct(F.lit(k).alias("ahead"), F.log(ratio).alias("score")))
    return out.select("near", F.inline(F.array(*ratios)))


def best_pair(cases: DataFrame, scores: DataFrame) -> DataFrame:
    """(ahead, insertion, deletion, tp, fp, fn, f1): the penalties, in tenths, that both together give the best F1 (of equal
    ones the greatest): a space comes or goes if its score is no less than its penalty. Both axes have at most MOST + 1 values,
    so that every pair is looked at in one row for each number of characters ahead."""
    scored = cases.join(scores, "near").withColumn("score", F.when(F.col("c"), -F.col("score")).otherwise(F.col("score")))
    tenth = F.least(F.floor(10 * F.col("score") + 1e-9), F.lit(MOST - 1)).cast("int")
    wrong = F.col("o") != F.col("c")
    bins = scored.select("ahead", "c", "cnt", wrong.alias("wrong"), F.greatest(tenth, F.lit(-1)).alias("t")).groupBy("ahead", "c", "t").agg(F.sum(F.when(F.col("wrong"), F.col("cnt")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("wrong"), 0).otherwise(F.col("cnt"))).alias("fp"))
    above = Window.partitionBy("ahead", "c").orderBy(F.desc("t"))  # at most MOST + 1 rows
    summed = bins.select("ahead", "c", "t", F.sum("tp").over(above).alias("tp"), F.sum("fp").over(above).alias("fp"), F.sum("tp").over(Window.partitionBy("ahead")).alias("due"))
    axis = lambda c: F.concat(F.collect_list(F.when((F.col("c") == c) & (F.col("t") >= 0), F.struct("t", "tp", "fp"))), F.array(F.struct(F.lit(MOST).alias("t"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))))
    axes = summed.groupBy("ahead").agg(F.max("due").alias("due"), axis(False).alias("comes"), axis(True).alias("goes"))

    def pair(i: Column, d: Column) -> Column:
        tp, fp = i["tp"] + d["tp"], i["fp"] + d["fp"]
        f1 = F.when(tp == 0, 0.0).otherwise(2.0 * tp / (tp + fp + F.col("due")))
        return F.struct(f1.alias("f1"), i["t"].alias("insertion"), d["t"].alias("deletion"), tp.alias("tp"), fp.alias("fp"), (F.col("due") - tp).alias("fn"))

    best = F.array_max(F.transform("comes", lambda i: F.array_max(F.transform("goes", lambda d: pair(i, d)))))
    return axes.select("ahead", best.alias("b")).select("ahead", "b.insertion", "b.deletion", "b.tp", "b.fp", "b.fn", "b.f1")
