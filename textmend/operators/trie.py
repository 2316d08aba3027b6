"""Words of a dictionary that are at most one edit away, as a walk through its trie finds them.

The walk takes the path of a word's characters as far as it can and turns off last where an edit helps: a character left
out, then for each child of the node, in the order in which words brought them there, another character in its place or one
more before it. Which turn comes first is all that the walk decides; what a turn leads to are the words that are equal but
for one place. So the trie is a table of (node, character, order), the words and the dictionary are keyed by what is left
without a place and by the place itself, and one equi-join and one choice for each word give what the walk gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the power of a word's share of all words that is its score.
POWER = 0.05


def entries(counts: DataFrame) -> DataFrame:
    """(token, cnt) of what a trie holds: words of several characters, and a."""
    return counts.where((F.length("token") > 1) | (F.col("token") == "a")).groupBy("token").agg(F.sum("cnt").alias("cnt"))


def children(dictionary: DataFrame) -> DataFrame:
    """(node, ch, order): the trie's edges, a node known by its characters; children stand in the order of their most frequent word."""
    at = dictionary.select("token", "cnt", F.explode(F.sequence(F.lit(0), F.length("token") - 1)).alias("p"))
    edge = at.select(F.substring("token", F.lit(1), F.col("p")).alias("node"), F.substring("token", F.col("p") + 1, F.lit(1)).alias("ch"), F.struct((-F.col("cnt")).alias("n"), "token").alias("order"))
    return edge.groupBy("node", "ch").agg(F.min("order").alias("order"))


def _without(word: str):
    return F.concat(F.substring(word, F.lit(1), F.col("p")), F.substring(word, F.col("p") + 2, F.length(word)))


def lookup(words: DataFrame, counts: DataFrame, damping: float = 0.1) -> DataFrame:
    """(word, token, spelled, edits, score): the entry that the walk of each distinct word finds first, the word spelled with it in
    its own letter case, and the entry's share to a power, damped by an edit. Words without an entry have no row."""
    d = entries(counts)
    total = d.agg(F.sum("cnt")).first()[0] or 1
    low = (F.length("word") > 2) & (F.substring("word", F.lit(2), F.length("word")) == F.lower(F.substring("word", F.lit(2), F.length("word"))))
    q = words.select("word").distinct().withColumn("w", F.when(low, F.concat(F.lower(F.substring("word", 1, 1)), F.substring("word", F.lit(2), F.length("word")))).otherwise(F.col("word")))
    exact = q.join(d.withColumnRenamed("token", "w"), "w").select("word", F.col("w").alias("token"), F.col("word").alias("spelled"), F.lit(0).alias("edits"), "cnt")
    rest = q.join(d.select(F.col("token").alias("w")), "w", "left_anti")
    places = rest.select("word", "w", F.explode(F.sequence(F.lit(0), F.length("w"))).alias("p"))
    inside = F.col("p") < F.length("w")
    cut = places.where(inside).select("word", "w", "p", _without("w").alias("key"))
    keyed = cut.select("word", "p", F.lit(1).alias("kind"), "key").unionAll(places.select("word", "p", F.lit(2).alias("kind"), F.col("w").alias("key")))
    gaps = d.select("token", "cnt", F.explode(F.sequence(F.lit(0), F.length("token") - 1)).alias("p")).select("token", "cnt", "p", _without("token").alias("key"), F.substring("token", F.col("p") + 1, F.lit(1)).alias("ch"))
    changed = keyed.join(gaps.where("ch <> \"'\""), ["key", "p"]).withColumn("node", F.substring("token", F.lit(1), F.col("p"))).join(children(d), ["node", "ch"])
    dropped = cut.join(d.withColumnRenamed("token", "key"), "key").select("word", "p", F.lit(0).alias("kind"), F.lit("").alias("ch"), F.col("key").alias("token"), "cnt", F.lit(None).cast(children(d).schema["order"].dataType).alias("order"))
    found = dropped.unionAll(changed.select("word", "p", "kind", "ch", "token", "cnt", "order"))
    first = F.min(F.struct((-F.col("p")).alias("p"), (F.col("kind") > 0).alias("keeps"), "order", "kind", "ch", "token", "cnt")).alias("b")
    best = found.groupBy("word").agg(first).select("word", "b.*").withColumn("p", -F.col("p"))
    after = F.when(F.col("kind") == 2, F.col("p")).otherwise(F.col("p") + 1)
    spelled = F.concat(F.substring("word", F.lit(1), F.col("p")), "ch", F.substring("word", after + 1, F.length("word")))
    both = exact.unionAll(best.select("word", "token", spelled.alias("spelled"), F.lit(1).alias("edits"), "cnt"))
    return both.select("word", "token", "spelled", "edits", (F.pow(F.col("cnt") / F.lit(float(total)), F.lit(POWER)) * F.when(F.col("edits") > 0, damping).otherwise(1.0)).alias("score"))
