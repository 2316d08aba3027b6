"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding, so the whole state is one token per
byte: appending a byte looks at the tokens that end there and keeps the one whose left neighbour (the stored token of
the shorter prefix) it can stand beside. Two tokens can stand beside each other if no merge across their border would
have come before the merges that built them. Encodings are read off backwards.

Edge cases: null and empty texts have no tokens and the digests of the empty string; texts of any length are encoded
whole; repeated rows yield repeated result rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from textmend.llm.common import id_and_text

#: Pieces a worker remembers before it starts afresh: bounds memory, never changes a result.
MEMORY = 200_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file (a token in base64 and its rank on each line) on the driver; a vocabulary is small."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


class Vocabulary:
    """Ranks with the two halves of every token, as its own merges build it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.usable = {t: r for t, r in ranks.items() if len(t) == 1}
        self.size_of = {r: len(t) for t, r in ranks.items()}
        self.known: dict[int, bool] = {}  # pairs that beside() was asked about
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (halves := self._halves(token, rank)):
                a, b = ranks[halves[0]], ranks[halves[1]]
                self.left[rank], self.right[rank], self.pair[a, b] = a, b, rank
                self.usable[token] = rank
        self.ending = ahocorasick.Automaton()
        for token, rank in self.usable.items():
            self.ending.add_word(token.decode("latin-1"), (len(token), rank))
        self.ending.make_automaton()

    def _halves(self, token: bytes, rank: int) -> tuple[bytes, bytes] | None:
        """The two parts left when only earlier merges are made; None if merges cannot build the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if all(p in self.ranks for p in parts) else None

    def beside(self, a: int, b: int) -> bool:
        """Whether b can follow a: walk down a's right edge and b's left edge, the later-built token first; at each
        step a merge of the two edge tokens must not come before the merges that used them (ties: the left one is first)."""
        used_a = used_b = 1 << 62
        while True:
            merge = self.pair.get((a, b))
            if merge is not None and merge < used_a and merge <= used_b:
                return False
            down_a, down_b = a in self.right, b in self.left
            if down_a and (a > b or not down_b):
                used_a, a = a, self.right[a]
            elif down_b:
                used_b, b = b, self.left[b]
            else:
                return True


def extend(v: Vocabulary, data: str, last: list[int], end: int) -> None:
    """Put the last tokens of all prefixes up to data[:end] behind those of shorter ones (data: a character a byte).
    The automaton tells the tokens that end at a place, longest first; only one of them can be right."""
    begin, known = len(last), v.known
    last += [-1] * (end + 1 - begin)
    for at, (size, token) in v.ending.iter(data, max(0, begin - v.longest), end):
        at += 1
        if at < begin or last[at] >= 0:
            continue
        if size < at:
            pair = last[at - size] << 32 | token
            ok = known.get(pair)
            if ok is None:
                if len(known) > MEMORY:
                    known.clear()
                ok = known[pair] = v.beside(last[at - size], token)
            if not ok:
                continue
        last[at] = token
    if -1 in last[begin:]:
        raise ValueError("a byte is missing from the vocabulary")


class PrefixEncoding:
    """The encoding of a growing or changing byte string: one last token per prefix."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, "", [-2]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data.decode("latin-1")
        extend(self.vocabulary, self.data, self.last, len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put new bytes for [start, stop). Returns how many prefixes were worked out again: those up to the point
        where, for as many bytes as the longest token has, old and new prefixes end alike."""
        old, step = self.last[stop + 1 :], self.vocabulary.longest
        self.data = self.data[:start] + new.decode("latin-1") + self.data[stop:]
        del self.last[start + 1 :]
        end = start + len(new)
        extend(self.vocabulary, self.data, self.last, end)
        while end < len(self.data):
            end = min(end + step, len(self.data))
            extend(self.vocabulary, self.data, self.last, end)
            done = end - start - len(new)
            if done >= step and self.last[-step:] == old[done - step : done]:
                self.last += old[done:]
                break
        return end - start

    def ids(self) -> list[int]:
        out, end, size_of = [], len(self.data), self.vocabulary.size_of
        while end:
            token = self.last[end]
            out.append(token)
            end -= size_of[token]
        out.reverse()
        return out


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one piece; a piece that is itself a token is that token."""
    whole = vocabulary.ranks.get(piece)
    return [whole] if whole is not None else PrefixEncoding(vocabulary, piece).ids()


def decode(vocabulary: Vocabulary, ids: list[int]) -> bytes:
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids))


class _Pieces(dict):
    """piece -> (number of ids, ids in decimal, bytes decoded from the ids)"""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[int, str, bytes]:
        ids = encode_piece(self.vocabulary, piece.encode())
        self[piece] = out = (len(ids), ",".join(map(str, ids)), decode(self.vocabulary, ids))
        return out


_built: dict[int, tuple[Vocabulary, _Pieces]] = {}


def _tables(ranks: dict[bytes, int]) -> tuple[Vocabulary, _Pieces]:
    """Built once in each Python worker."""
    key = hash(frozenset(ranks.items()))
    if key not in _built:
        _built.clear()
        vocabulary = Vocabulary(ranks)
        _built[key] = vocabulary, _Pieces(vocabulary)
    return _built[key]


def _batches(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    find, pieces = regex.compile(pattern).findall, _tables(ranks)[1]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text in batch.column(1):
            if len(pieces) > MEMORY:
                pieces.clear()
            found = [pieces[x] for x in find(text.as_py())]
            ids = ",".join([x[1] for x in found])
            out[0].append(sum([x[0] for x in found]))
            out[1].append(hashlib.sha256(ids.encode()).hexdigest())
            out[2].append(hashlib.sha256(b"".join([x[2] for x in found])).hexdigest())
            if with_ids:
                out[3].append([int(x) for x in ids.split(",")] if ids else [])
        cols = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array(out[3], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names=names)
    if len(pieces) > MEMORY // 4:  # the worker may go on to other work
        pieces.clear()


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]), one row per input row; no shuffle."""
    rows = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = f"doc_id {dict(rows.dtypes)['id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(lambda b: _batches(b, shared.value, pattern, with_ids), schema)
