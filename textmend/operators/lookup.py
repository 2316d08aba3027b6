"""Counts that a text's repair asks for, joined with it: the tables of counts stay DataFrames and are whole.

Rows are dealt out to chunks of about equally many characters. Each chunk's texts name the keys that their repair can
ask for, the keys are joined with the whole table, and the counts found come back to the chunk. No table of counts is
collected or broadcast as a whole. What is broadcast are the most frequent keys, of a fixed number, and a bit filter of at most 32 MB: it
keeps every key that the table has, and the join drops the keys that it lets through by chance."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textmend.functions.batches import pieces
from textmend.operators.language_model import ORDER, gap_gram_codes, numbered, spelled

#: Characters of a chunk: bounds what a task holds, not what is looked up.
CHARACTERS = 1 << 18
LEAST_BITS, MOST_BITS, BITS_PER_KEY = 1 << 15, 1 << 28, 16
#: Most frequent keys that every task has; distinct words that a task holds before it hands on their hashes.
COMMON, HELD = 200_000, 500_000
#: Characters whose spans are hashed together.
TOGETHER = 1 << 19


#: Characters of a chunk of many texts, where so many chunks come together; up to then chunks are smaller, so that all tasks have some.
MANY, CHUNKS = 1 << 22, 64


def dealt(rows: DataFrame, key: str, characters: int, most: int = MANY) -> DataFrame:
    """rows by the ``chunk`` that each is to meet its counts in, by a hash of the key. characters: of all texts; most: of a chunk of many texts. The
    larger a chunk is, the fewer of its keys are asked for elsewhere too. There are as many partitions as Spark would make itself, so
    that chunks are not dealt out twice, and not put together, however few bytes they have: what is done with them takes long."""
    n = max(characters // most, min(characters // CHARACTERS, CHUNKS)) + 1
    partitions = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(n))).repartition(partitions, "chunk")


def chunked(rows: DataFrame, key: str, text: str, characters: int = CHARACTERS) -> DataFrame:
    """rows with their ``chunk``, by a hash of the key, so that copies of a text are spread."""
    n = (rows.agg(F.sum(F.length(text))).first()[0] or 0) // characters + 1
    return rows.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(n))).repartition(n, "chunk")


class Filter:
    """Bits of hashed keys; a key of the table is always in it."""

    def __init__(self, table: DataFrame, n: int | None = None):
        """n: about how many keys the table has, where that is known."""
        bits = LEAST_BITS
        n = table.count() if n is None else n
        while bits < min(MOST_BITS, n * BITS_PER_KEY):
            bits *= 2
        place = self.hashed(table).bitwiseAND(F.lit(bits - 1)) + 1  # Spark's bit numbers begin with 1
        maps = self.hashes(table).select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
        whole = bytearray(bits // 8)
        for r in maps.toLocalIterator():
            at = (r["b"] - 1) * 4096
            whole[at : at + 4096] = r["m"]
        self.mask, self.shared = bits - 1, table.sparkSession.sparkContext.broadcast(bytes(whole))

    def hashes(self, table: DataFrame) -> DataFrame:
        return table

    def hashed(self, table: DataFrame) -> Column:
        return F.xxhash64("key")

    def passed(self, keys: Iterable[str]) -> Iterator[str]:
        bits, mask, digest = self.shared.value, self.mask, xxhash.xxh64_intdigest
        for key in keys:
            h = digest(key.encode(), 42) & mask
            if bits[h >> 3] >> (h & 7) & 1:
                yield key


#: An odd factor and its inverse modulo 2^64: a span's hash is a difference of sums over the text, whatever its place.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
PROBES = 3


def span_hashes(text: str) -> Callable[..., np.ndarray]:
    """The hashes of spans (begins, ends) of the text; with ``holes``, of the spans without the character at a place in each; with ``cuts``, of
    the spans with a space before the character at a place in each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    powers = lambda base: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(codes), base, np.uint64))))
    forth = powers(FACTOR)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * forth[:-1])))
    back = powers(INVERSE)

    def of(begins: np.ndarray, ends: np.ndarray, holes: np.ndarray | None = None, cuts: np.ndarray | None = None) -> np.ndarray:
        if cuts is not None:
            h = sums[cuts] - sums[begins] + (sums[ends] - sums[cuts]) * np.uint64(FACTOR) + forth[cuts] * np.uint64(ord(" ") + 1)
        else:
            h = sums[ends] - sums[begins] if holes is None else sums[holes] - sums[begins] + (sums[ends] - sums[holes + 1]) * np.uint64(INVERSE)
        h = h * back[begins]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    return of


def probe(h: np.ndarray, k: int) -> np.ndarray:
    return h if k == 0 else (h * np.uint64(0xA24BAED4963EE407 + 2 * k)) >> np.uint64(33)


class SpanFilter(Filter):
    """Bits of keys whose hashes of all spans of a text are worked out at once, PROBES of each key."""

    def hashes(self, table: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                ends = np.cumsum([len(k) for k in keys]) if keys else np.zeros(0, np.int64)
                h = span_hashes("".join(keys))(np.concatenate(([0], ends))[:-1].astype(np.int64), ends)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([probe(h, k) for k in range(PROBES)]).view(np.int64))], names=["h"])

        return table.select("key").mapInArrow(run, "h bigint")

    def hashed(self, table: DataFrame) -> Column:
        return F.col("h")

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be those of a key."""
        bits, mask, at = np.frombuffer(self.shared.value, np.uint8), np.uint64(self.mask), np.arange(len(h))
        for k in range(PROBES):
            place = probe(h[at], k) & mask
            at = at[(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        return at

    def stumps(self, words: list[str]) -> tuple[list[str], list[str]]:
        """(word, stump) of words and of what is left of them without a character, where that may be a key."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        hashes, word = span_hashes("".join(words)), np.repeat(np.arange(len(words)), sizes)
        whole = self.may_hold(hashes(ends - sizes, ends)).tolist()
        holed = self.may_hold(hashes((ends - sizes)[word], ends[word], np.arange(len(word))))
        cut = [(words[k], i) for k, i in zip(word[holed].tolist(), (holed - (ends - sizes)[word[holed]]).tolist(), strict=True)]
        kept = [words[k] for k in whole]
        return kept + [w for w, _ in cut], kept + [w[:i] + w[i + 1 :] for w, i in cut]

    def spans(self, texts: Iterable[str], sizes: list[int]) -> set[str]:
        """What the texts have of these sizes that may be a key."""
        bits, mask, out = np.frombuffer(self.shared.value, np.uint8), np.uint64(self.mask), set()
        texts = list(texts)
        whole, lengths = "".join(texts), np.array([len(t) for t in texts], np.int64)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(whole))  # characters to the end of the text
        hashes, at = span_hashes(whole), np.arange(len(whole))
        for size in sorted(sizes):
            at = at[left[at] >= size]
            if not len(at):
                break
            begins, h = at, hashes(at, at + size)
            for k in range(PROBES):
                place = probe(h, k) & mask
                kept = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                begins, h = begins[kept], h[kept]
            out.update(whole[a : a + size] for a in begins.tolist())
        return out

    def edges(self, texts: Iterable[str], longest: int, pairs: SpanFilter | None = None, cut: int = 25) -> set[str]:
        """What may be a key of what repairs that join neighbours and cut words in two can ask for: words, what they make up with those before
        them, up to ``longest`` characters, and the parts of words of up to ``cut`` characters. With pairs, "left right" of these too; then words are
        cut only where that is one, and what is left can be joined with the next word."""
        texts = list(texts)
        words = pc.split_pattern(pa.array(texts, pa.string()), " ")
        per_text, named = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64), words.flatten().dictionary_encode()
        whole, distinct, at = "".join(texts).replace(" ", ""), named.dictionary.to_pylist(), named.indices.to_numpy(zero_copy_only=False)
        each, once = np.array([len(w) for w in distinct], np.int64), "".join(distinct)
        stops = np.cumsum(each)
        is_known = np.zeros(len(distinct), np.bool_)
        is_known[self.may_hold(span_hashes(once)(stops - each, stops))] = True
        sizes, known = each[at], is_known[at]
        ends = np.cumsum(sizes)
        begins, text_begins = ends - sizes, np.repeat(np.concatenate(([0], ends))[np.cumsum(per_text) - per_text], per_text)
        word, place, out = (self if pairs is None else pairs).cuts(distinct, cut if pairs is None else None, pairs is None)
        if pairs is None:
            word = word[:0]
        else:
            out.update(*[o.split(" ") for o in out])
        out.update([w for w, k in zip(distinct, is_known.tolist(), strict=True) if k])
        # begins of what can stand before a word: words, and parts of words
        many = np.bincount(word, minlength=len(distinct))[at]
        of = np.repeat(np.arange(len(at)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        inside = begins[of] + place[np.searchsorted(word, at[of]) + nth] if len(of) else begins[:0]
        real = sizes > 0
        begins, ends, text_begins, known = begins[real], ends[real], text_begins[real], known[real]
        froms = np.union1d(begins, inside)
        hashes, k = span_hashes(whole), np.searchsorted(froms, begins)
        while True:
            k = k - 1
            kept = (k >= 0) & (froms[k] >= text_begins) & (ends - froms[k] <= longest)
            k, begins, ends, text_begins, known = k[kept], begins[kept], ends[kept], text_begins[kept], known[kept]
            if not len(ends):
                return out
            begin = froms[k]
            some = self.may_hold(hashes(begin, ends))
            out.update([whole[a:b] for a, b in zip(begin[some].tolist(), ends[some].tolist(), strict=True)])
            if pairs is not None:
                some = some[known[some] & (begin[some] < begins[some])]
                begin, middle, end = begin[some], begins[some], ends[some]
                some = self.may_hold(hashes(begin, middle))
                begin, middle, end = begin[some], middle[some], end[some]
                some = pairs.may_hold(hashes(begin, end, None, middle))
                out.update([f"{whole[a:c]} {whole[c:b]}" for a, c, b in zip(begin[some].tolist(), middle[some].tolist(), end[some].tolist(), strict=True)])

    def cuts(self, words: list[str], longest: int | None = None, parts: bool = False) -> tuple[np.ndarray, np.ndarray, set[str]]:
        """(word, place) where a word with a space put in may be a key, and these keys; with parts, the same of its two parts."""
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        out: set[str] = set()
        for a, b in pieces(words):
            sizes = np.array([len(w) for w in words[a:b]], np.int64)
            ends, whole = np.cumsum(sizes), "".join(words[a:b])
            row, at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(whole))
            kept = (at > (ends - sizes)[row]) & (longest is None or sizes[row] <= longest)
            at, row = at[kept], row[kept]
            begins, stops, hashes = (ends - sizes)[row], ends[row], span_hashes(whole)
            if parts:
                some = self.may_hold(hashes(begins, at))
                out.update([whole[x:y] for x, y in zip(begins[some].tolist(), at[some].tolist(), strict=True)])
                some = self.may_hold(hashes(at, stops))
                out.update([whole[x:y] for x, y in zip(at[some].tolist(), stops[some].tolist(), strict=True)])
            else:
                some = self.may_hold(hashes(begins, stops, None, at))
                out.update([f"{whole[x:c]} {whole[c:y]}" for x, c, y in zip(begins[some].tolist(), at[some].tolist(), stops[some].tolist(), strict=True)])
            found.append((a + row[some], (at - begins)[some]))
        return np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found]), out


class SnippetFilter(SpanFilter):
    """The same of what stands between spaces in texts, which are hashed where they are; table: (text)."""

    def hashes(self, table: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[str] = set()

            def made() -> pa.RecordBatch:
                ends = np.cumsum([len(w) for w in seen], dtype=np.int64)
                h = span_hashes("".join(seen))(np.concatenate(([0], ends))[: len(seen)].astype(np.int64), ends)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([probe(h, k) for k in range(PROBES)]).view(np.int64))], names=["h"])

            for batch in batches:
                for text in batch.column(0).to_pylist():
                    seen.update((text or "").split(" "))
                if len(seen) > HELD:
                    yield made()
                    seen.clear()
            yield made()

        return table.mapInArrow(run, "h bigint")


def mostly(table: DataFrame, n: int | None = None, value: str = "cnt") -> Broadcast:
    """The n most frequent keys with their counts, or another value: every chunk has them, and asks for others only."""
    kept = table.orderBy(F.desc("cnt"), "key").limit(COMMON if n is None else n).select("key", value).toArrow()
    return table.sparkSession.sparkContext.broadcast(dict(zip(*[c.to_pylist() for c in kept.columns], strict=True)))


def found_spans(rows: DataFrame, text: str, table: DataFrame, longest: int | None = None, common: Broadcast | None = None) -> DataFrame:
    """``found`` of all spans of up to ``longest`` characters of the texts without spaces; without it, of all sizes that the
    table's keys have. common: keys that are not asked for."""
    known = SpanFilter(table)
    size = F.length("key")
    sizes = [r[0] for r in table.where(F.lit(True) if longest is None else size <= longest).select(size).distinct().collect() if r[0]]  # few: a key of its own for each

    def asked(rows: pa.Table) -> pa.Table:
        texts, wanted = [t.replace(" ", "") for t in texts_of(rows, text)], set()
        for a, b in pieces(texts):
            wanted |= known.spans(texts[a:b], sizes)
        wanted = list(wanted.difference(common.value) if common else wanted)
        return pa.table([pa.array([rows.column("chunk")[0].as_py()] * len(wanted), pa.int64()), pa.array(wanted, pa.string())], names=["chunk", "key"])

    wanted = rows.select("chunk", text).groupBy("chunk").applyInArrow(lambda rows: asked(rows), "chunk bigint, key string")
    return wanted.join(table.select("key", "cnt"), "key").select("chunk", "key", "cnt")


def found_edges(rows: DataFrame, text: str, table: DataFrame, pairs: DataFrame | None = None, common: Broadcast | None = None) -> DataFrame:
    """``found`` of what ``SpanFilter.edges`` of the texts are, in the table and in that of pairs. common: keys that are not asked for."""
    known = SpanFilter(table)
    near = None if pairs is None else SpanFilter(pairs)
    longest = table.agg(F.max(F.length("key"))).first()[0] or 0

    def asked(rows: pa.Table) -> pa.Table:
        texts, wanted = list(texts_of(rows, text)), set()
        for a, b in pieces(texts, TOGETHER):
            wanted |= known.edges(texts[a:b], longest, near)
        wanted = list(wanted.difference(common.value) if common else wanted)
        return pa.table([pa.array([rows.column("chunk")[0].as_py()] * len(wanted), pa.int64()), pa.array(wanted, pa.string())], names=["chunk", "key"])

    every = table.select("key", "cnt") if pairs is None else table.select("key", "cnt").unionAll(pairs.select("key", "cnt"))
    wanted = rows.select("chunk", text).groupBy("chunk").applyInArrow(lambda rows: asked(rows), "chunk bigint, key string")
    return wanted.join(every, "key").select("chunk", "key", "cnt")


def edge_pairs_asked(texts: set[str], known: dict[str, int]) -> set[str]:
    """"left right" of the known parts of each word, and of each known word and a known span before it that make up a known one."""
    tails = {word[k:] for word in known for k in range(len(word))}
    out: set[str] = set()
    cut: set[str] = set()
    for text in texts:
        s, end = text.replace(" ", ""), 0
        for word in text.split(" "):
            begin, end = end, end + len(word)
            if word not in cut:
                cut.add(word)
                out.update(f"{word[:i]} {word[i:]}" for i in range(1, len(word)) if word[:i] in known and word[i:] in known)
            if word in known:
                at = begin - 1
                while at >= 0 and (whole := s[at:end]) in tails:
                    if whole in known and (left := s[at:begin]) in known:
                        out.add(f"{left} {word}")
                    at -= 1
    return out


def texts_of(rows: pa.Table, text: str) -> set[str]:
    return set(rows.column(text).to_pylist()) - {None}


def counts_of(rows: pa.Table) -> dict[str, int]:
    return dict(zip(rows.column("key").to_pylist(), rows.column("cnt").to_pylist(), strict=True))


def found(rows: DataFrame, text: str, keys: Callable[..., Iterable[str]], table: DataFrame, before: DataFrame | None = None, common: Broadcast | None = None) -> DataFrame:
    """(chunk, key, cnt): what the table (key, cnt) has of the keys that each chunk's texts ask for. keys gets a chunk's
    texts, and its counts of ``before`` where these are given. common: keys that are not asked for."""
    known = Filter(table)
    schema = pa.schema([("chunk", pa.int64()), ("key", pa.string())])

    def asked(*sides: pa.Table) -> pa.Table:
        if not sides[0].num_rows:
            return schema.empty_table()
        more = [counts_of(side) for side in sides[1:]]
        wanted = set(keys(texts_of(sides[0], text), *more))
        wanted = list(known.passed(wanted.difference(common.value) if common else wanted))
        return pa.table([pa.array([sides[0].column("chunk")[0].as_py()] * len(wanted), pa.int64()), pa.array(wanted, pa.string())], schema=schema)

    grouped = rows.select("chunk", text).groupBy("chunk")
    if before is None:
        wanted = grouped.applyInArrow(lambda rows: asked(rows), "chunk bigint, key string")
    else:
        wanted = grouped.cogroup(before.groupBy("chunk")).applyInArrow(lambda rows, counts: asked(rows, counts), "chunk bigint, key string")
    return wanted.join(table.select("key", "cnt"), "key").select("chunk", "key", "cnt")


def each(function: Callable[[str], str]) -> Callable[[list[str]], list[str]]:
    """A function of a text as one of several."""
    return lambda texts: [function(t) for t in texts]


def repaired(rows: DataFrame, text: str, counts: DataFrame, make: Callable[[dict[str, int]], Callable[[list[str]], list[str]]], out: str = "predicted",
             common: Broadcast | None = None, use: Callable[[pa.Table], pa.Table] | None = None, fields: list[StructField] | None = None) -> DataFrame:
    """rows without their chunk, with the texts repaired by the function that ``make`` builds from the chunk's counts. common: counts that
    all chunks have. use: makes other columns (fields) of these rows at once."""
    kept = [f for f in rows.schema.fields if f.name != "chunk"]

    def run(mine: pa.Table, found: pa.Table) -> pa.Table:
        function = make((common.value if common else {}) | counts_of(found))
        texts = sorted(texts_of(mine, text))
        done: dict[str | None, str | None] = {None: None} | dict(zip(texts, function(texts), strict=True))
        made = mine.drop_columns(["chunk"]).append_column(out, pa.array([done[t] for t in mine.column(text).to_pylist()], pa.string()))
        return use(made) if use else made

    return rows.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(run, StructType(fields or [*kept, StructField(out, StringType())]))


def word_spans(longest: int) -> Callable[[str], Iterator[tuple[int, int]]]:
    """All places (begin, end) of up to ``longest`` characters in the text without spaces."""

    def spans(text: str) -> Iterator[tuple[int, int]]:
        n = len(text) - text.count(" ")
        return ((a, b) for b in range(1, n + 1) for a in range(max(0, b - longest), b))

    return spans


def edge_spans(longest: int) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Those that begin or end where a word of the text does."""

    def spans(text: str) -> Iterator[tuple[int, int]]:
        at = 0
        for word in text.split(" "):
            begin, at = at, at + len(word)
            yield from ((a, at) for a in range(max(0, at - longest), at))
            yield from ((begin, b) for b in range(begin + 1, min(at, begin + longest + 1)))

    return spans


def neighbour_spans(window: int) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Runs of up to ``window`` words of the text, and the parts of each word cut in two."""

    def spans(text: str) -> Iterator[tuple[int, int]]:
        ends = [0]
        for word in text.split(" "):
            ends.append(ends[-1] + len(word))
        for k in range(1, len(ends)):
            yield from ((ends[b], ends[k]) for b in range(max(0, k - window), k))
            yield from ((ends[k - 1], c) for c in range(ends[k - 1] + 1, ends[k]))
            yield from ((c, ends[k]) for c in range(ends[k - 1] + 1, ends[k]))

    return spans


def words_asked(spans: Callable[[str], Iterator[tuple[int, int]]]) -> Callable[..., set[str]]:
    def keys(texts: set[str]) -> set[str]:
        out: set[str] = set()
        for text in texts:
            s = text.replace(" ", "")
            out.update(s[a:b] for a, b in spans(text))
        return out

    return keys


def heads_of(known: Iterable[str], longest: int) -> set[str]:
    """All beginnings, of up to ``longest`` characters, of known words."""
    return {word[:k] for word in known for k in range(1, min(longest, len(word)) + 1)}


def known_pairs_asked(longest: int) -> Callable[..., set[str]]:
    """``pairs_asked`` of all spans of up to ``longest`` characters: a place is followed only as far as a known word goes on."""

    def keys(texts: set[str], known: dict[str, int]) -> set[str]:
        out: set[str] = set()
        heads = heads_of(known, longest)
        for text in texts:
            s = text.replace(" ", "")
            ending: dict[int, list[str]] = {}
            for a in range(len(s)):
                lefts = ending.pop(a, ())
                for b in range(a + 1, min(a + longest, len(s)) + 1):
                    word = s[a:b]
                    if word not in heads:
                        break
                    if word in known:
                        ending.setdefault(b, []).append(word)
                        out.update([f"{left} {word}" for left in lefts])
        return out

    return keys


def pairs_asked(spans: Callable[[str], Iterator[tuple[int, int]]]) -> Callable[..., set[str]]:
    """"left right" of all known words that can stand side by side."""

    def keys(texts: set[str], known: dict[str, int]) -> set[str]:
        out: set[str] = set()
        for text in texts:
            s = text.replace(" ", "")
            ending: dict[int, set[str]] = {}
            beginning: dict[int, set[str]] = {}
            for a, b in spans(text):
                if (word := s[a:b]) in known:
                    ending.setdefault(b, set()).add(word)
                    beginning.setdefault(a, set()).add(word)
            for at, lefts in ending.items():
                out.update(f"{left} {right}" for right in beginning.get(at, ()) for left in lefts)
        return out

    return keys


def grams_asked(texts: set[str]) -> set[str]:
    """Keys of the counts that the probabilities of the texts' grams are made of: =gram and <context, of all orders."""
    number, bits = numbered(list(texts))
    grams = spelled(gap_gram_codes(list(texts), number, bits), number, bits)
    parts = {gram[k:] for gram in grams for k in range(ORDER)}
    return {"=" + p for p in parts} | {"<" + p[:-1] for p in parts}


def one_space_grams_asked(texts: set[str]) -> set[str]:
    """``grams_asked`` of searches that put at most one space into a gap, whatever the text has there."""
    return grams_asked({t.replace(" ", "") for t in texts})


def gram_table(counted: DataFrame) -> DataFrame:
    """(key, cnt): the counts (gram, cnt) added up for all orders' grams (=gram) and contexts (<context)."""
    parts = F.transform(F.sequence(F.lit(1), F.lit(ORDER)), lambda k: F.substring("gram", k, F.lit(ORDER)))
    keys = F.flatten(F.transform(parts, lambda p: F.array(F.concat(F.lit("="), p), F.concat(F.lit("<"), F.substring(p, F.lit(1), F.length(p) - 1)))))
    return counted.select(F.explode(keys).alias("key"), "cnt").groupBy("key").agg(F.sum("cnt").alias("cnt"))
