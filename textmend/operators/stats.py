"""Corpus statistics. Counting explodes rows and adds up with partial sums; only counts are shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmend.functions import text as T
from textmend.functions.arrays import running_sums
from textmend.functions.batches import pieces, tokens_of


def character_frequencies(rows: DataFrame, text: str = "text") -> DataFrame:
    """(ch, cnt)"""
    return rows.select(F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("cnt"))


def token_frequencies(rows: DataFrame, text: str = "text") -> DataFrame:
    """(token, cnt) of tokens between white space."""
    return rows.select(F.explode(F.split(text, T.WS + "+")).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("cnt"))


def top(frequencies: DataFrame, n: int, key: str, count: str = "cnt", key_descending: bool = False) -> DataFrame:
    """The n most frequent: a partial top n in each task, then one of them all."""
    return frequencies.orderBy(F.desc(count), F.desc(key) if key_descending else F.asc(key)).limit(n)


def ranked(frequencies: DataFrame, key: str, count: str = "cnt", most: int | None = None) -> DataFrame:
    """frequencies with ``rank`` from 0 by (count, key) descending. With ``most`` only the first so many are ranked."""
    rows = top(frequencies, most, key, count, True) if most else frequencies
    return rows.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc(count), F.desc(key))) - 1).cast("long"))


def unigrams(rows: DataFrame, text: str = "text") -> DataFrame:
    """(token, delimiter_before, cnt)"""
    return rows.select(F.inline(T.tokens(F.col(text)))).groupBy("token", "delimiter_before").agg(F.count("*").alias("cnt"))


def merged_unigrams(unigrams: DataFrame) -> DataFrame:
    return unigrams.groupBy("token").agg(F.sum("cnt").alias("cnt"))


def bigrams(rows: DataFrame, text: str = "text") -> DataFrame:
    """(left, right, cnt) of neighbours within a row."""
    t = F.transform(T.tokens(F.col(text)), lambda x: x["token"])
    pairs = F.arrays_zip(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))).alias("left"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("right"))
    return rows.select(t.alias("t")).where(F.size("t") > 1).select(F.inline(pairs)).toDF("left", "right").groupBy("left", "right").agg(F.count("*").alias("cnt"))


#: Characters that a task cuts into tokens together, and distinct keys that it holds before it hands on their counts.
TOGETHER, HELD = 1 << 19, 500_000


def _counted(rows: DataFrame, text: str, keys: Callable[[list[str], np.ndarray], list[str]]) -> DataFrame:
    """(key, cnt) of the keys that ``tokens_of`` texts give. They are counted where they are; what is shuffled are a task's distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["key", "cnt"])
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in pieces(texts, TOGETHER):
                seen.update(keys(*tokens_of(texts[a:b])))
                if len(seen) > HELD:
                    yield made()
                    seen = Counter()
        yield made()

    return rows.select(text).mapInArrow(run, "key string, cnt bigint").groupBy("key").agg(F.sum("cnt").alias("cnt"))


def token_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """(key, cnt): ``merged_unigrams``, counted in arrays."""
    return _counted(rows, text, lambda tokens, row: tokens)


def pair_counts(rows: DataFrame, wanted: Callable[[list[str]], np.ndarray] | None = None, text: str = "text") -> DataFrame:
    """(key, cnt): ``bigrams`` as "left right", counted in arrays. wanted: which neighbours (k, k + 1) of tokens count at all."""

    def keys(tokens: list[str], row: np.ndarray) -> list[str]:
        near = row[1:] == row[:-1]
        at = np.flatnonzero(near if wanted is None else near & wanted(tokens)).tolist()
        return [f"{tokens[k]} {tokens[k + 1]}" for k in at]

    return _counted(rows, text, keys)


def vocabulary(rows: DataFrame, text: str = "text", more_than: int = 2) -> DataFrame:
    """(word, freq) of words that occur more often than ``more_than``."""
    words = rows.select(F.explode(T.words(F.col(text))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") > more_than)


def interpolated(bigrams: DataFrame, unigrams: DataFrame) -> DataFrame:
    """(left, right, p): half the unigram share of right, half the share of right among what follows left."""
    total = unigrams.agg(F.sum("cnt").alias("total"))
    u = unigrams.select(F.col("token").alias("right"), F.col("cnt").alias("n_right"))
    v = unigrams.select(F.col("token").alias("left"), F.col("cnt").alias("n_left"))
    joined = bigrams.join(u, "right").join(v, "left").crossJoin(F.broadcast(total))  # total: one row
    return joined.select("left", "right", (0.5 * F.col("n_right") / F.col("total") + 0.5 * F.col("cnt") / F.col("n_left")).alias("p"))


def stumps(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, stump): the token itself and it without one of its characters."""
    t = F.col("_t")
    made = F.transform(F.sequence(F.lit(0), F.length(t)), lambda i: F.when(i == 0, t).otherwise(F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))
    return tokens.select(F.col(token).alias("_t")).select("_t", F.explode(F.array_distinct(made)).alias("stump")).withColumnRenamed("_t", "token")


def one_edit(a: Column, b: Column) -> Column:
    """Equal, one insertion, deletion or replacement apart, or one exchange of neighbours."""
    i = F.length(F.regexp_extract(F.concat_ws("\x00", a, b), r"^(.*).*\x00\1", 1))  # their common beginning
    x, y = F.substring(a, i + 1, F.length(a)), F.substring(b, i + 1, F.length(b))
    swapped = (F.length(a) == F.length(b)) & (F.substring(x, 1, 1) == F.substring(y, 2, 1)) & (F.substring(x, 2, 1) == F.substring(y, 1, 1)) & (F.substring(x, F.lit(3), F.length(x)) == F.substring(y, F.lit(3), F.length(y)))
    return (F.levenshtein(a, b) <= 1) | swapped


def fuzzy_join(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(query, token): pairs at most one edit apart. Both sides are keyed by their stumps, so that the join is an equi-join."""
    q = stumps(queries.toDF("token")).withColumnRenamed("token", "query")
    return q.join(stumps(dictionary.toDF("token")), "stump").select("query", "token").distinct().where(one_edit(F.col("query"), F.col("token")))


def best_splits(tokens: DataFrame, unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(token, left, right, cnt): the split of each token whose bigram is most frequent; ties go to the rarer part's higher
    count, then to the shorter left part."""
    cut = tokens.where("length(token) > 1").select("token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    parts = cut.select("token", "i", F.substring("token", F.lit(1), F.col("i")).alias("left"), F.substring("token", F.col("i") + 1, F.length("token")).alias("right"))
    known = parts.join(bigrams, ["left", "right"])
    u = unigrams.select("token", "cnt")
    scored = known.join(u.select(F.col("token").alias("left"), F.col("cnt").alias("n_left")), "left").join(u.select(F.col("token").alias("right"), F.col("cnt").alias("n_right")), "right")
    best = F.max(F.struct("cnt", F.least("n_left", "n_right").alias("least"), (-F.col("i")).alias("i"), "left", "right")).alias("b")
    return scored.groupBy("token").agg(best).select("token", "b.left", "b.right", "b.cnt")


def matched_lines(truth: DataFrame, inputs: DataFrame, key=T.remove_spaces) -> DataFrame:
    """(input_id, true_id): inputs equal to a true line but for what the key drops; of equal true lines the last counts."""
    t = truth.select(key(F.col("text")).alias("key"), F.col("id").alias("true_id")).groupBy("key").agg(F.max("true_id").alias("true_id"))
    return inputs.select(key(F.col("text")).alias("key"), F.col("id").alias("input_id")).join(t, "key").select("input_id", "true_id")


def matched_spans(truth: DataFrame, inputs: DataFrame) -> DataFrame:
    """(true_id, seq_id, last_seq_id): for each true line (id, text) the first run of a document's lines (doc_id, seq_id, text)
    that is equal to it but for spaces. A document's lines are joined once; a run is looked at only if it is as long as some true
    line, and then meets the true lines by an equi-join. The lengths are a set of at most as many numbers as the longest true
    line has characters."""
    t = truth.select(T.remove_spaces(F.col("text")).alias("key"), F.col("id").alias("true_id")).where("key <> ''").groupBy("key").agg(F.max("true_id").alias("true_id"))
    lengths = t.agg(F.sort_array(F.collect_set(F.length("key"))).alias("lengths"))
    d = inputs.select("doc_id", F.struct("seq_id", T.remove_spaces(F.col("text")).alias("m")).alias("l")).where("l.m <> ''")
    d = d.groupBy("doc_id").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    d = d.select(F.array_join(F.transform("ls", lambda x: x["m"]), "").alias("w"), F.transform("ls", lambda x: x["seq_id"]).alias("ids"), running_sums(F.transform("ls", lambda x: F.length(x["m"]))).alias("ends"))
    first = d.crossJoin(F.broadcast(lengths)).select("w", "ids", "ends", "lengths", F.posexplode("ids").alias("i", "seq_id"))  # lengths: one row
    begin = F.when(F.col("i") == 0, F.lit(0).cast("long")).otherwise(F.get("ends", F.col("i") - 1))
    first = first.withColumn("begin", begin).withColumn("ends_here", F.array_intersect(F.slice("ends", F.col("i") + 1, F.size("ends")), F.transform("lengths", lambda n: F.col("begin") + n)))
    runs = first.select("seq_id", "w", "ids", "ends", "begin", F.explode("ends_here").alias("end"))
    runs = runs.select("seq_id", F.get("ids", (F.array_position("ends", F.col("end")) - 1).cast("int")).alias("last_seq_id"), F.substring("w", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int")).alias("key"))
    return runs.join(t, "key").groupBy("true_id").agg(F.min(F.struct("seq_id", "last_seq_id")).alias("s")).select("true_id", "s.*")


def seeded_order(seed: int, key: str) -> Column:
    """A random order that is the same everywhere."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def split_names(rows: DataFrame, key: str, sizes: dict[str, float], seed: int) -> DataFrame:
    """rows with ``split``: each row by its own hash, so that no order of all rows is needed."""
    share = F.conv(F.substring(seeded_order(seed, key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    at, out = 0.0, None
    for name, size in sizes.items():
        at += size
        out = F.when(share < at, name) if out is None else out.when(share < at, name)
    return rows.withColumn("split", out.otherwise(next(reversed(sizes))))


def abbreviations(rows: DataFrame, text: str = "text", least: int = 3, ratio: float = 2.0) -> DataFrame:
    """(token, with_dot, without_dot): short tokens mostly seen with a full stop."""
    t = rows.select(F.explode(F.split(text, T.WS + "+")).alias("t")).where(r"t rlike '\\p{L}' and length(t) <= 6")
    stem = F.regexp_replace("t", r"\.$", "")
    counted = t.select(stem.alias("token"), F.col("t").endswith(".").cast("long").alias("dot")).where("token <> '' and not contains(token, '.')").groupBy("token").agg(F.sum("dot").alias("with_dot"), F.sum(1 - F.col("dot")).alias("without_dot"))
    return counted.where((F.col("with_dot") >= least) & ((F.col("without_dot") == 0) | (F.col("with_dot") > ratio * F.col("without_dot"))))
