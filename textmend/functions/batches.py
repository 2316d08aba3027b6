"""Noise, tokens, rules for marks and error counts of whole batches: the characters of many texts are one array, worked through
piece by piece."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from textmend.functions.rng import FACTOR, MODULUS, PRIMES

#: Characters that are looked at together; a longer text is a piece of its own.
PIECE = 1 << 17
SPACE = 32
COUNTS = ("tp_del", "fp_del", "fn_del", "tp_ins", "fp_ins", "fn_ins")


def pieces(texts: list[str], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters (PIECE)."""
    most = PIECE if most is None else most
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def remainder(x: np.ndarray, by: int, negative: bool) -> np.ndarray:
    """Of the sign of x, as in the JVM and in SQL."""
    return np.fmod(x, by) if negative else x - x // by * by


def uniforms(seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """``rng.at_place`` of arrays."""
    negative = bool(len(seeds)) and int(seeds.min()) < 0
    x = remainder(seeds + (places + FACTOR) * PRIMES[3], MODULUS, negative)
    x = remainder(x * (remainder(x, PRIMES[1], negative) + 1), MODULUS, negative)
    return remainder(x * PRIMES[2], MODULUS, negative) / float(MODULUS)


def respaced(texts: list[str], seeds: np.ndarray, p_insert: np.ndarray, p_delete: np.ndarray) -> list[str]:
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    codes, row = codes_of("".join(texts)), np.repeat(np.arange(len(texts)), sizes)
    places = np.arange(len(codes)) - (ends - sizes)[row]
    u = uniforms(seeds[row], places)
    space = codes == SPACE
    behind = np.concatenate(([False], ~space[:-1])) & (places > 0)  # the character before is no space
    gone = space & (u < p_delete[row])
    comes = ~space & behind & (u < p_insert[row])
    after = np.cumsum(1 + comes - gone)  # characters of the result up to each one
    out = np.full(int(after[-1]) if len(after) else 0, SPACE, np.uint32)
    out[after[~gone] - 1] = codes[~gone]
    said = out.tobytes().decode("utf-32-le", "surrogatepass")
    cuts = np.concatenate(([0], after))[np.concatenate(([0], ends))].tolist()
    return [said[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def corrupt(text: pa.Array, seed: pa.Array, p_insert: pa.Array, p_delete: pa.Array) -> pa.Array:
    """seed: ``rng.row_seed`` of each text."""
    texts = ["" if t is None else t for t in text.to_pylist()]
    seeds = seed.fill_null(0).to_numpy(zero_copy_only=False)
    shares = [p.fill_null(-1.0).to_numpy(zero_copy_only=False) for p in (p_insert, p_delete)]
    out: list[str | None] = []
    for a, b in pieces(texts):
        out += respaced(texts[a:b], seeds[a:b], *[p[a:b] for p in shares])
    for k in np.flatnonzero((text.is_null().to_numpy(zero_copy_only=False)) | (seed.is_null().to_numpy(zero_copy_only=False))).tolist():
        out[k] = None
    return pa.array(out, pa.string())


def gaps_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The gaps of all texts, and how many the texts up to each one have."""
    codes = codes_of("$".join(texts) + "$")
    at = np.flatnonzero(codes != SPACE)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.diff(at, prepend=-1) - 1, np.searchsorted(at, ends)


def counted(true: list[str], corrupt: list[str], predicted: list[str]) -> np.ndarray:
    """The COUNTS of each text."""
    (o, ends), *others = [gaps_of(t) for t in (true, corrupt, predicted)]
    if any(not np.array_equal(ends, e) for _, e in others):
        raise ValueError("texts to compare differ in more than spaces")
    (c, _), (p, _) = others
    odd = np.flatnonzero((o != c) | (p != c))  # the other gaps count for nothing
    row, o, c, p = np.searchsorted(ends, odd, side="right"), o[odd], c[odd], p[odd]
    parts = ((o > c) & (p > c), (o <= c) & (p > c), (o > c) & (p <= c), np.maximum(0, c - np.maximum(o, p)), np.maximum(0, np.minimum(o, c) - p), np.maximum(0, np.minimum(p, c) - o))
    return np.array([np.bincount(row, weights=x, minlength=len(true)) for x in parts]).astype(np.int64)


def error_counts(true: pa.Array, corrupt: pa.Array, predicted: pa.Array) -> pa.Array:
    """tp, fp and fn of the predicted repairs, by type, each a sum over gaps; null where a text is."""
    three = [[t or "" for t in a.to_pylist()] for a in (true, corrupt, predicted)]
    none = np.logical_or.reduce([a.is_null().to_numpy(zero_copy_only=False) for a in (true, corrupt, predicted)])
    for k in np.flatnonzero(none).tolist():
        for texts in three:
            texts[k] = ""
    made = [counted(*[t[a:b] for t in three]) for a, b in pieces(three[0])] or [np.zeros((len(COUNTS), 0), np.int64)]
    columns = [pa.array(c, pa.int64(), mask=none) for c in np.concatenate(made, axis=1)]
    return pa.StructArray.from_arrays(columns, names=list(COUNTS))


#: Kinds of characters: not looked up yet, white space, letters, digits, all else.
UNSEEN, BLANK, LETTER, DIGIT, SIGN = range(5)


@cache
def kinds() -> np.ndarray:
    return np.zeros(0x110000, np.uint8)


def kinds_of(codes: np.ndarray) -> np.ndarray:
    table = kinds()
    out = table[codes]
    if not out.all():
        for c in np.unique(codes[out == UNSEEN]).tolist():
            table[c] = BLANK if chr(c) in " \t\n\v\f\r" else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], SIGN)
        out = table[codes]
    return out


def tokens_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The tokens of all texts, as ``text.tokens`` has them, and the number of the text that each is from."""
    whole, sizes = "".join(texts), np.array([len(t) for t in texts], np.int64)
    codes, n = codes_of(whole), int(sizes.sum())
    if not n:
        return [], np.zeros(0, np.int64)
    text_ends = np.cumsum(sizes)
    first = np.zeros(n, np.bool_)
    first[(text_ends - sizes)[sizes > 0]] = True
    kind = kinds_of(codes)
    blank = kind == BLANK
    begin = ~blank & (first | (kind == SIGN) | (kind != np.concatenate(([UNSEEN], kind[:-1]))))
    cuts = np.flatnonzero(begin | blank | first)
    some = begin[cuts]
    begins, ends = cuts[some], np.append(cuts[1:], n)[some]
    behind = np.maximum(begins - 1, 0)
    row = np.searchsorted(text_ends, begins, side="right")
    begins = begins - (~first[begins] & blank[behind] & (codes[behind] != SPACE))  # white space that is no space stays with the token behind it
    return [whole[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], row


#: Snippets that stick to their left or right neighbour.
NO_SPACE_BEFORE, NO_SPACE_AFTER = [".", ",", ")", "]", "?", "!", ";", ":", "'", "'s"], ["(", "["]
_BEFORE, _AFTER, _MARKS = frozenset(NO_SPACE_BEFORE), frozenset(NO_SPACE_AFTER), frozenset([*NO_SPACE_BEFORE, *NO_SPACE_AFTER, '"', "-"])
_LINE_ENDS = "\n\r\u0085\u2028\u2029"


def _is_number(s: str) -> bool:
    """One end of a line may follow, as in the JVM's patterns."""
    s = s[:-2] if s.endswith("\r\n") else s[:-1] if s[-1:] and s[-1] in _LINE_ENDS else s
    return bool(s) and all(unicodedata.category(c)[0] == "N" for c in s)


def tidied(text: str) -> str:
    """``rules.postprocess`` of a text."""
    snippets = text.split(" ")
    if _MARKS.isdisjoint(snippets) and not any([s.isnumeric() for s in snippets]) and not any(c in text for c in _LINE_ENDS):
        return text
    out, last, glue, quotes = [], "", True, 0
    for s, after in zip(snippets, [*snippets[1:], ""], strict=True):
        before = now = False
        if s in _MARKS:
            closing = s == '"' and quotes % 2 == 1
            hyphen = s == "-" and last.isalpha() and after[:1].isalpha()
            before, now = s in _BEFORE or closing or hyphen, s in _AFTER or (s == '"' and not closing) or hyphen
            quotes += s == '"'
        elif last and unicodedata.category(last)[0] == "N":
            before = _is_number(s)
        if not (glue or before):
            out.append(" ")
            last = " "
        if s:
            out.append(s)
            last = s[-1]
        glue = now
    return "".join(out)


def postprocess(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else tidied(t) for t in text.to_pylist()], pa.string())
