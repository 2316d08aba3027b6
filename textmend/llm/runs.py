"""Periodic runs of words, all of them, by the runs theorem.

A run is a stretch of words of smallest period q and of length 2q or more that no neighbour extends. Every run holds the
longest Lyndon word that starts at one of its places, under an order of words or under its reverse, and that word is as
long as the period. So each place is asked for two Lyndon words only: it ends before the next place whose suffix is smaller
(next smaller value of the inverse suffix array), for the reverse order before the next whose suffix is larger. Each is a root
that is extended to the right by the longest common prefix of two suffixes, a range minimum over the array of common
prefixes (sparse table), and to the left by the same on the reversed words. What is as long as asked for is a run.

Spark deals out the documents; each task works on many documents at once in arrays: their words are numbered document by
document, so that suffixes of different documents differ in their first word. Memory is some 200 bytes for each word of a
batch of texts; texts of more than ``WORDS`` words are worked on alone.

Edge cases: null and empty texts have no words and no runs; rows that share an id are separate texts; a null id stays; an empty
table yields an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Words worked on at once, at least; the least length of a run.
WORDS, SHORTEST = 1 << 17, 12
#: Steps to the next smaller value that are tried one by one before the sparse table is asked.
STEPS = 24


class Suffixes:
    """Suffix array of texts one behind the other, their common prefixes, and range minima over these. words: numbers that no two
    texts share; end: for each place the end of its text. A suffix that is a prefix of another is smaller."""

    def __init__(self, words: np.ndarray, end: np.ndarray):
        n = len(words)
        # a rank is the number of smaller suffixes, or of those that are smaller in the first h words
        size = np.bincount(words)
        rank = (np.cumsum(size) - size)[words].astype(np.int32)
        shared, levels, h = size[words] > 1, [rank], 1
        while shared.any():
            at = np.flatnonzero(shared)
            beyond = at + h
            second = np.where(beyond < end[at], rank[np.minimum(beyond, n - 1)] + np.int64(1), 0)
            order = np.argsort(rank[at] * np.int64(n + 1) + second)
            at, first, second = at[order], rank[at][order], second[order]
            new_group = np.concatenate(([True], first[1:] != first[:-1]))
            new = new_group | np.concatenate(([True], second[1:] != second[:-1]))
            place = np.arange(len(at))
            group = np.maximum.accumulate(np.where(new_group, place, 0))
            head = np.maximum.accumulate(np.where(new, place, 0))
            rank = rank.copy()
            rank[at] = first + (head - group)
            alone = new & np.concatenate((new[1:], [True]))
            shared = np.zeros(n, np.bool_)
            shared[at[~alone]] = True
            levels.append(rank)
            h *= 2
        self.rank = rank
        array = np.empty(n, np.int64)
        array[rank] = np.arange(n)
        self.minima = [self._prefixes(array, levels)]
        while 2 << (len(self.minima) - 1) <= n:
            low, k = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(low[:-k], low[k:]))

    @staticmethod
    def _prefixes(array: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each suffix and the next smaller one begin with, from the ranks of the first 1, 2, 4, ... words."""
        out = np.zeros(len(array), np.int32)
        at = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
        a, b, n = array[at - 1], array[at], len(array)
        for k in range(len(levels) - 1, -1, -1):
            same = (np.maximum(a, b) < n) & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
            step = same.astype(np.int64) << k
            a, b = a + step, b + step
            out[at] += step.astype(np.int32)
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j, different places of one text each, begin with."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            mine = level == k
            table = self.minima[k]
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k)])
        return out


def next_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length."""
    n = len(x)
    out = np.full(n, n)
    at = np.arange(n - 1)
    for step in range(1, STEPS + 1):
        smaller = x[at + step] < x[at]
        out[at[smaller]] = at[smaller] + step
        at = at[~smaller]
        at = at[at + step + 1 < n]
        if not len(at):
            return out
    minima = [x]
    while 2 << (len(minima) - 1) <= n:
        low, k = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(low[:-k], low[k:]))
    place = at + STEPS + 1
    for k in range(len(minima) - 1, -1, -1):
        table = minima[k]
        skip = (place < len(table)) & (table[np.minimum(place, len(table) - 1)] > x[at])
        place = place + (skip.astype(np.int64) << k)
    out[at] = place
    return out


def runs(words: np.ndarray, begin: np.ndarray, end: np.ndarray, shortest: int) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period, as places in the texts one behind the other."""
    n = len(words)
    forward = Suffixes(words, end)
    place = np.arange(n)
    smaller, larger = np.minimum(next_smaller(forward.rank), end), next_smaller(-forward.rank)
    # past its end, a text goes on with what is smaller than all words, and in the reverse order larger
    roots = np.concatenate((np.stack((place, smaller - place), axis=1), np.stack((place, larger - place), axis=1)[larger < end]))
    i, p = roots.T
    most = end[i] - begin[i]
    fits = np.maximum(shortest, 2 * p) <= most
    i, p = i[fits], p[fits]
    j = i + p
    right = np.zeros(len(i), np.int64)
    inside = np.flatnonzero(j < end[i])
    inside = inside[words[i[inside]] == words[j[inside]]]
    right[inside] = forward.common(i[inside], j[inside])
    lacking = np.maximum(np.maximum(shortest, 2 * p) - p - right, 0)  # words to the left that make it long enough
    # these are all there only if the farthest and the nearest of them are
    able = i - lacking >= begin[i]
    able[able] = (lacking[able] == 0) | (words[np.maximum(i[able] - lacking[able], 0)] == words[np.maximum(j[able] - lacking[able], 0)]) & (words[i[able] - 1] == words[j[able] - 1])
    i, p, j, right, lacking = (x[able] for x in (i, p, j, right, lacking))
    if not len(i):
        return np.zeros((0, 3), np.int64)
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > begin[i])
    inner = inner[words[i[inner] - 1] == words[j[inner] - 1]]
    if len(inner):
        backward = Suffixes(words[::-1], n - begin[::-1])
        left[inner] = backward.common(n - i[inner], n - j[inner])
    found = np.stack((i - left, left + p + right, p), axis=1)[left >= lacking]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def numbered(split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers that no two texts share, and the texts' sizes."""
    numbers, first = [], 0
    for words in split:
        seen: dict[str, int] = {}
        numbers += [first + seen.setdefault(w, len(seen)) for w in words]
        first += len(seen)
    return np.array(numbers, np.int64), np.array([len(words) for words in split], np.int64)


def runs_of(split: list[list[str]], shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of texts one behind the other, and the texts' sizes."""
    numbers, sizes = numbered(split)
    ends = np.cumsum(sizes)
    return runs(numbers, np.repeat(ends - sizes, sizes), np.repeat(ends, sizes), shortest) if len(numbers) else np.zeros((0, 3), np.int64), sizes


def _found(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    word = re.compile(WORD).findall
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batch_of(ids: pa.Array, split: list[list[str]]) -> pa.RecordBatch:
        got, sizes = runs_of(split, shortest)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        text = np.searchsorted(ends, got[:, 0], "right")
        cut = np.searchsorted(text, np.arange(len(split) + 1))
        drop = np.zeros(sizes.sum() + 1, np.int64)
        np.add.at(drop, got[:, 0] + got[:, 2], 1)
        np.add.at(drop, got[:, 0] + got[:, 1], -1)
        keep = np.cumsum(drop) == 0
        collapsed = [" ".join(words if a == b else [w for w, k in zip(words, keep[s : s + len(words)].tolist(), strict=True) if k]) for words, s, a, b in zip(split, begins.tolist(), cut[:-1], cut[1:], strict=True)]
        got[:, 0] -= begins[text]
        fields = [pa.array(got[:, k]) for k in range(3)]
        lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), lists, pa.array(collapsed, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    for batch in batches:
        first, held, n = 0, [], 0
        for k, text in enumerate(batch.column(1)):
            held.append(word(text.as_py()))
            n += len(held[-1])
            if n >= WORDS or k + 1 == batch.num_rows:
                yield batch_of(batch.column(0).slice(first, k + 1 - first), held)
                first, held, n = k + 1, [], 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): runs of ``shortest`` words or more by start, then
    period; collapsed are the words, joined by a space, without those that a run has after its first period."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _found(b, shortest), f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def repeated_tail(words: Column, first: Column, period: Column) -> Column:
    """An array whose elements from ``first`` on (from 0) repeat those of one period."""
    n = F.size(words)
    times = F.ceil((n - first) / period).cast("int")
    return F.concat(F.slice(words, F.lit(1), first), F.slice(F.flatten(F.array_repeat(F.slice(words, first + 1, period), times)), F.lit(1), n - first))
