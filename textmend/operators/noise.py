"""Spelling noise on tokens, as column expressions. Each token's fate depends on (seed, row, place) alone."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textmend.functions.arrays import let
from textmend.functions.batches import pieces, uniforms
from textmend.functions.rng import at_place, row_seed

#: What scanners mistake for what.
OCR = [("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("e", "c"), ("c", "e"), ("i", "l"), ("l", "i"), ("o", "0"), ("s", "5"), ("b", "6")]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def per_token(text: Column, row: Column, seed: int, one) -> Column:
    """The text with one(token, draw) for each token between spaces; draw(k) is the token's k-th random number."""

    def all_of(m: Column) -> Column:
        return F.array_join(F.transform(m["tokens"], lambda t, i: one(t, lambda k: at_place(m["seed"], i.cast("long") * 8 + k))), " ")

    return let(F.struct(F.split(text, " ").alias("tokens"), row_seed(seed, row).alias("seed")), all_of)


def _pick(u: Column, n) -> Column:
    return F.floor(u * n).cast("int")


def _letter(u: Column, letters: str = LETTERS) -> Column:
    return F.substring(F.lit(letters), _pick(u, len(letters)) + 1, F.lit(1))


def typos(text: Column, row: Column, p: float, seed: int, letters: str = LETTERS) -> Column:
    """With p, one edit in a token of two or more letters only: a letter put in, taken out, replaced or exchanged with the next.
    letters: what is put in, marks as well where they are given."""

    def one(t: Column, draw) -> Column:
        at = _pick(draw(2), F.length(t) - 1)
        head, here, rest = F.substring(t, F.lit(1), at), F.substring(t, at + 1, F.lit(1)), F.substring(t, at + 2, F.length(t))
        kind = _pick(draw(1), 4)
        edited = F.when(kind == 0, F.concat(head, _letter(draw(3), letters), here, rest)).when(kind == 1, F.concat(head, rest)).when(kind == 2, F.concat(head, _letter(draw(3), letters), rest)).otherwise(
            F.concat(head, F.substring(rest, 1, 1), here, F.substring(rest, F.lit(2), F.length(rest))))
        return F.when((F.length(t) > 1) & t.rlike(r"^\p{L}+$") & (draw(0) < p), edited).otherwise(t)

    return per_token(text, row, seed, one)


def hyphens(text: Column, row: Column, p: float, seed: int) -> Column:
    """With p, a hyphen and a space between two letters of a word of four or more."""

    def one(t: Column, draw) -> Column:
        at = 2 + _pick(draw(1), F.length(t) - 3)
        return F.when((F.length(t) >= 4) & t.rlike(r"^\p{L}+$") & (draw(0) < p), F.concat(F.substring(t, F.lit(1), at), F.lit("- "), F.substring(t, at + 1, F.length(t)))).otherwise(t)

    return per_token(text, row, seed, one)


def ocr_errors(text: Column, row: Column, p: float, seed: int) -> Column:
    """With p, the first occurrence of a randomly chosen pattern of the confusion table is taken for its counterpart."""

    def one(t: Column, draw) -> Column:
        which = _pick(draw(1), len(OCR))
        changed = t
        for k, (wrong, seen) in enumerate(OCR):
            at = F.instr(t, F.lit(wrong))
            changed = F.when((which == k) & (at > 0), F.concat(F.substring(t, F.lit(1), at - 1), F.lit(seen), F.substring(t, at + len(wrong), F.length(t)))).otherwise(changed)
        return F.when(draw(0) < p, changed).otherwise(t)

    return per_token(text, row, seed, one)


def misread(t: str, u: list[float]) -> str:
    """``ocr_errors`` of a drawn token, u its draws from the second on."""
    wrong, seen = OCR[int(u[0] * len(OCR))]
    return t.replace(wrong, seen, 1)


def mistyped(t: str, u: list[float]) -> str:
    """``typos`` of a drawn token."""
    said = t[:-2] if t.endswith("\r\n") else t[:-1] if t[-1:] in ("\n", "\r", "\x85", "\u2028", "\u2029") else t  # the pattern's $ stands before these
    if len(t) < 2 or not said.isalpha():
        return t
    kind, at, letter = int(u[0] * 4), int(u[1] * (len(t) - 1)), LETTERS[int(u[2] * len(LETTERS))]
    head, here, rest = t[:at], t[at], t[at + 1 :]
    return head + (letter + here + rest, rest, letter + rest, rest[:1] + here + rest[1:])[kind]


def respelled(texts: list[str], seeds: np.ndarray, p: float, one: Callable[[str, list[float]], str]) -> list[str]:
    """The texts with one(token, draws) for the tokens that are drawn with p: the random numbers of all tokens are one array."""
    tokens = [t.split(" ") for t in texts]
    sizes = np.array([len(t) for t in tokens])
    row = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    drawn = np.flatnonzero(uniforms(seeds[row], place * 8) < p)
    row, place = row[drawn], place[drawn]
    draws = np.stack([uniforms(seeds[row], place * 8 + k) for k in (1, 2, 3)], axis=1).tolist()
    for r, i, u in zip(row.tolist(), place.tolist(), draws, strict=True):
        tokens[r][i] = one(tokens[r][i], u)
    return [" ".join(t) for t in tokens]


def of_batches(text: Column, row: Column, p: float, seed: int, one: Callable[[str, list[float]], str]) -> Column:
    """``ocr_errors`` (one: misread) or ``typos`` (mistyped) of whole batches. text: a column without lambdas in it, which
    Spark would not tell apart."""

    def run(text: pa.Array, seed: pa.Array) -> pa.Array:
        texts, seeds = ["" if t is None else t for t in text.to_pylist()], seed.fill_null(0).to_numpy(zero_copy_only=False)
        out = [t for a, b in pieces(texts) for t in respelled(texts[a:b], seeds[a:b], p, one)]
        return pa.array(out, pa.string(), mask=text.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, StringType())(text, row_seed(seed, row))


def characters(text: Column, row: Column, p: float, seed: int) -> Column:
    """Each character goes with p / 2, or gets a letter before it with p / 2."""

    def all_of(m: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            u = at_place(m["seed"], i.cast("long"))
            return F.when(u < p / 2, "").when(u < p, F.concat(_letter(at_place(m["other"], i.cast("long"))), c)).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    return let(F.struct(row_seed(seed, row).alias("seed"), row_seed(seed + 1, row).alias("other")), all_of)


def mixed(text: Column, row: Column, p_hyphen: float, p_ocr: float, p_typo: float, share_ocr: float, seed: int) -> Column:
    """Hyphens first, then either OCR errors or typos in the whole row."""
    hyphened = hyphens(text, row, p_hyphen, seed)
    return F.when(at_place(row_seed(seed + 1, row), F.lit(0)) < share_ocr, ocr_errors(hyphened, row, p_ocr, seed + 2)).otherwise(typos(hyphened, row, p_typo, seed + 3))
