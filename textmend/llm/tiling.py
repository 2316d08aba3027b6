"""Benchmark decontamination by greedy string tiling.

Words are compared by rolling (Karp-Rabin) hashes. Every window of ``min_match`` words of a document that is also a
window of a benchmark item is a seed; seeds on one diagonal join to maximal matches; the longest match is marked as a
tile in both texts, again and again, until none of ``min_match`` unmarked words is left. A document leaks an item if
the tiles cover at least ``coverage`` of the item's words, in whatever order they stand.

The benchmark is the stated query set: it is read in blocks of at most ``BLOCK_CHARS`` characters, each block is
broadcast, and the documents are passed once for each block, without a shuffle.

Edge cases: words are runs of letters, digits and marks, compared in lower case; an item of fewer words than
``min_match`` must occur as a whole; null and wordless texts and items match nothing; repeated documents or items yield
repeated rows; texts are read whole.
"""

from __future__ import annotations

import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textmend.llm.common import id_and_text

MIN_MATCH, COVERAGE, BLOCK_CHARS, SLICE_CHARS = 5, 0.6, 4_000_000, 500_000
_STEP, _ROLL = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: is it part of words, and its hash value (0 outside words)."""
    word = np.fromiter((c.isalnum() or unicodedata.category(c)[0] == "M" for c in map(chr, range(0x110000))), np.bool_, 0x110000)
    return word, np.where(word, _mix(np.arange(1, 0x110001, dtype=np.uint64) * _STEP), np.uint64(0))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    n, inverse = SLICE_CHARS + 1, pow(int(_STEP), -1, 1 << 64)
    make = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))))
    return make(_STEP), make(np.uint64(inverse))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the place of each text's first word (one more at the end)."""
    word, value = _characters()
    power, inverse = _powers()
    texts = [t.lower() for t in texts]
    hashes, counts = [], []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < SLICE_CHARS):
            size += len(texts[end]) + 1
            end += 1
        codes = np.frombuffer("\n".join(texts[at:end]).encode("utf-32-le"), np.uint32)
        inside = word[codes]
        edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if size > SLICE_CHARS:  # one very long text: word by word powers, not from its start
            h = np.array([int((value[codes[a:b]] * power[: b - a]).sum()) if b - a <= SLICE_CHARS else int.from_bytes(hashlib.blake2b(codes[a:b].tobytes(), digest_size=8).digest(), "little") for a, b in zip(starts, ends, strict=True)], np.uint64)
        else:
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[codes] * power[: len(codes)], dtype=np.uint64)))
            h = (total[ends] - total[starts]) * inverse[starts]
        hashes.append(_mix(h))
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[at:end]])))
        counts.append(np.diff(np.searchsorted(starts, begins)))
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of all runs of ``size`` words."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    n, out = len(hashes) - size + 1, np.zeros(len(hashes) - size + 1, np.uint64)
    for j in range(size):
        out = out * _ROLL + hashes[j : j + n]
    return _mix(out)


class Seeds:
    """All windows of a block of items: hash -> places, for each window size that occurs."""

    def __init__(self, items: list[tuple[object, str]], min_match: int = MIN_MATCH):
        words, first = word_hashes([t for _, t in items])
        self.ids, self.sizes = [i for i, _ in items], np.diff(first)
        self.by_size = []
        for size in range(1, min_match + 1):
            hashes, owner, place = [], [], []
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                if b - a == size or size == min_match < b - a:
                    w = windows(words[a:b], size)
                    hashes.append(w)
                    owner.append(np.full(len(w), k))
                    place.append(np.arange(len(w)))
            if hashes:
                hashes, owner, place = (np.concatenate(x) for x in (hashes, owner, place))
                order = np.argsort(hashes, kind="stable")
                seeds = hashes[order]
                unique, at = np.unique(seeds, return_index=True)
                quick = np.zeros(1 << 20, np.bool_)
                quick[unique >> np.uint64(44)] = True
                self.by_size.append((size, unique, np.concatenate((at, [len(seeds)])), owner[order], place[order], quick))

    def matches(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(text, item, maximal matches as (length, place in item, place in text)) for all pairs with a seed. Seeds are met
        in pieces of a bounded number of pairs, each of which leaves its runs along diagonals only: a word that fills
        text and item makes one run a diagonal."""
        for size, unique, at, owner, place, quick in self.by_size:
            w = windows(words, size)
            found = np.flatnonzero(quick[w >> np.uint64(44)])
            if not len(found):
                continue
            seed = np.searchsorted(unique, w[found])
            ok = (seed < len(unique)) & (unique[np.minimum(seed, len(unique) - 1)] == w[found])
            found, seed = found[ok], seed[ok]
            text = np.searchsorted(first, found, side="right") - 1
            ok = found + size <= first[text + 1]  # within one text
            found, seed, text = found[ok], seed[ok], text[ok]
            if not len(found):
                continue
            runs = merged_runs([r for begin in pieces(at[seed + 1] - at[seed]) for r in (self._runs(found[begin], seed[begin], text[begin], first, at, owner, place),)])
            text, item, j, i, length = runs
            pair = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(item) != 0))))
            rows = list(zip((length + size - 1).tolist(), j.tolist(), i.tolist(), strict=True))
            for a, b in zip(pair.tolist(), [*pair[1:].tolist(), len(rows)], strict=True):
                yield int(text[a]), int(item[a]), rows[a:b]

    @staticmethod
    def _runs(found: np.ndarray, seed: np.ndarray, text: np.ndarray, first: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Rows text, item, place in item, place in text, number of seeds in a row on one diagonal."""
        times = at[seed + 1] - at[seed]
        rank = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        entry = np.repeat(at[seed], times) + rank
        text, i = np.repeat(text, times), np.repeat(found - first[text], times)
        item, j = owner[entry], place[entry]
        return merged_runs([np.stack((text, item, j, i, np.ones(len(i), np.int64)))])


#: Pairs of a place in a text and a place in an item that are looked at at a time.
PAIRS = 1 << 18


def pieces(times: np.ndarray) -> Iterator[slice]:
    """Slices of seeds that make about PAIRS pairs each."""
    ends = np.cumsum(times)
    begin = 0
    while begin < len(times):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, side="right")))
        yield slice(begin, end)
        begin = end


def merged_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Runs (text, item, place in item, place in text, length), those that go on where another ends made one, in order."""
    text, item, j, i, length = np.concatenate(runs, axis=1)
    order = np.lexsort((j, i - j, item, text))
    text, item, j, i, length = (x[order] for x in (text, item, j, i, length))
    same = (np.diff(text) == 0) & (np.diff(item) == 0) & (np.diff(i - j) == 0) & (j[1:] == j[:-1] + length[:-1])
    run = np.flatnonzero(np.concatenate(([True], ~same)))
    return np.stack((text[run], item[run], j[run], i[run], np.add.reduceat(length, run)))


def tile(found: list[tuple[int, int, int]], n_item: int, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in item, place in text): the longest match first, earlier places first at ties; a
    match that runs into marked words is cut to its unmarked runs and waits for its turn again."""
    heap = [(-n, j, i) for n, j, i in found]
    heapq.heapify(heap)
    item_marks, text_marks, tiles = bytearray(n_item), set(), []
    while heap:
        n, j, i = heapq.heappop(heap)
        free = [not item_marks[j + k] and i + k not in text_marks for k in range(-n)]
        if all(free):
            tiles.append((-n, j, i))
            item_marks[j : j - n] = b"\1" * -n
            text_marks.update(range(i, i - n))
            if all(item_marks):
                break
            continue
        start = None
        for k, ok in enumerate([*free, False]):
            if ok and start is None:
                start = k
            elif not ok and start is not None:
                if k - start >= min_match:
                    heapq.heappush(heap, (start - k, j + start, i + start))
                start = None
    return tiles


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Place of the first and the texts of runs of about SLICE_CHARS characters: what is held at a time is bounded by
    that or by one text. Null texts are empty."""
    first, run, size = 0, [], 0
    for k, text in enumerate(texts):
        run.append(text.as_py() or "")
        size += len(run[-1])
        if size >= SLICE_CHARS or k + 1 == len(texts):
            yield first, run
            first, run, size = k + 1, [], 0


def leaks(seeds: Seeds, texts: pa.Array, min_match: int, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, covered words, tiles, longest tile) of the pairs whose coverage is enough."""
    for begin, run in slices(texts):
        words, first = word_hashes(run)
        for text, item, found in seeds.matches(words, first):
            n = int(seeds.sizes[item])
            tiles = tile(found, n, min(min_match, n))
            covered = sum(t[0] for t in tiles)
            if covered >= coverage * n:
                yield begin + text, item, covered, len(tiles), tiles[0][0]


#: The seeds of the last block that this Python worker has seen: built once, not for each task.
_held: list = []


def seeds_of(block: list[tuple[object, str]], min_match: int) -> Seeds:
    if not _held or _held[0] is not block or _held[1] != min_match:
        _held[:] = [block, min_match, Seeds(block, min_match)]
    return _held[2]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The query set, a bounded block at a time."""
    block, size = [], 0
    for row in id_and_text(benchmark, item_col, text_col).toLocalIterator():
        if block and size + len(row.text) > chars:
            yield block
            block, size = [], 0
        block.append((row.id, row.text))
        size += len(row.text)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile) for each document and item it leaks."""
    rows = id_and_text(docs, id_col, text_col)
    item_field = id_and_text(benchmark, item_col, item_text_col).schema["id"].dataType
    schema = f"doc_id {dict(rows.dtypes)['id']}, item_id {item_field.simpleString()}, item_words bigint, covered_words bigint, coverage double, n_tiles bigint, longest_tile bigint"
    out = rows.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark, item_col, item_text_col):
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = seeds_of(shared.value, min_match)
            for batch in batches:
                got = list(leaks(seeds, batch.column(1), min_match, coverage))
                text, item, covered, n, longest = (list(x) for x in zip(*got, strict=True)) if got else ([],) * 5
                size = [int(seeds.sizes[k]) for k in item]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(text, pa.int64())), pa.array([seeds.ids[k] for k in item], to_arrow_type(item_field)), pa.array(size, pa.int64()), pa.array(covered, pa.int64()),
                    pa.array([c / s for c, s in zip(covered, size, strict=True)], pa.float64()), pa.array(n, pa.int64()), pa.array(longest, pa.int64()),
                ], names=["doc_id", "item_id", "item_words", "covered_words", "coverage", "n_tiles", "longest_tile"])

        out = out.unionAll(rows.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns, that leak no item. Rows only pass through tasks; nothing is shuffled."""
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = seeds_of(shared.value, min_match)
            for batch in batches:
                keep = np.ones(batch.num_rows, np.bool_)
                keep[[k for k, *_ in leaks(seeds, batch.column(at), min_match, coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
