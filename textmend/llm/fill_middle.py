"""Fill-in-the-middle examples over ropes.

A text is a rope: a balanced tree whose leaves hold whole units (lines) and know how many units and code points they have, as
do the nodes above. Splitting at two unit ranks gives prefix, middle and suffix as trees that share their leaves with the text;
an example is a concatenation of these with sentinels in another order; nothing is copied but the leaves that a cut goes
through and the path to them. A text is restored from an example by splitting its tree at the sentinels' code points.

Where to cut and which order to take are draws from a digest of seed and id alone: the same on any cluster.

Edge cases: null texts are empty; empty texts and texts that hold a sentinel stay as they are (form plain); cuts may fall
together or at an end, so that each part can be empty; a null id draws as an empty one; rows that share an id draw alike;
very long lines are leaves of their own; an empty table yields an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A unit with its line break, the sentinels, and code points that leaves of several units have at most.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LEAF = 1 << 10
SEED, EXAMPLE_PERCENT, SPM_PERCENT = 7, 100, 50


@dataclass(slots=True)
class Rope:
    """A leaf (text) or a node (left, right); the empty rope is None."""

    units: int
    points: int
    height: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None


def leaf(text: str, units: int) -> Rope | None:
    return Rope(units, len(text), 0, text) if text else None


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.points + b.points, 1 + max(a.height, b.height), None, a, b)


def concatenated(a: Rope | None, b: Rope | None) -> Rope | None:
    """One rope after the other: the lower one is hung into the higher, whose heights stay within one of each other."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return _balanced(a.left, concatenated(a.right, b))
    if b.height > a.height + 1:
        return _balanced(concatenated(a, b.left), b.right)
    return _node(a, b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """A node of two ropes whose heights are two apart at most."""
    if b.height > a.height + 1:
        if b.left.height > b.right.height:
            return _node(_node(a, b.left.left), _node(b.left.right, b.right))
        return _node(_node(a, b.left), b.right)
    if a.height > b.height + 1:
        if a.right.height > a.left.height:
            return _node(_node(a.left, a.right.left), _node(a.right.right, b))
        return _node(a.left, _node(a.right, b))
    return _node(a, b)


def built(leaves: list[Rope]) -> Rope | None:
    """A tree of least height."""
    while len(leaves) > 1:
        leaves = [_node(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0] if leaves else None


def rope(text: str, unit: re.Pattern) -> Rope | None:
    leaves, held, n = [], [], 0
    for piece in unit.findall(text):
        if held and n + len(piece) > LEAF:
            leaves.append(leaf("".join(held), len(held)))
            held, n = [], 0
        held.append(piece)
        n += len(piece)
    return built([*leaves, leaf("".join(held), len(held))] if held else leaves)


def split_units(r: Rope | None, rank: int, unit: re.Pattern) -> tuple[Rope | None, Rope | None]:
    """The first ``rank`` units and the rest."""
    if r is None or rank <= 0:
        return None, r
    if rank >= r.units:
        return r, None
    if r.text is not None:
        at = 0
        for k, m in enumerate(unit.finditer(r.text), 1):
            if k == rank:
                at = m.end()
                break
        return leaf(r.text[:at], rank), leaf(r.text[at:], r.units - rank)
    if rank < r.left.units:
        a, b = split_units(r.left, rank, unit)
        return a, concatenated(b, r.right)
    a, b = split_units(r.right, rank - r.left.units, unit)
    return concatenated(r.left, a), b


def split_points(r: Rope | None, rank: int) -> tuple[Rope | None, Rope | None]:
    """The first ``rank`` code points and the rest; a leaf that is cut counts its units no longer."""
    if r is None or rank <= 0:
        return None, r
    if rank >= r.points:
        return r, None
    if r.text is not None:
        return leaf(r.text[:rank], 0), leaf(r.text[rank:], 0)
    if rank < r.left.points:
        a, b = split_points(r.left, rank)
        return a, concatenated(b, r.right)
    a, b = split_points(r.right, rank - r.left.points)
    return concatenated(r.left, a), b


def spelled(r: Rope | None) -> str:
    out, stack = [], [r] if r else []
    while stack:
        x = stack.pop()
        if x.text is not None:
            out.append(x.text)
        else:
            stack += [x.right, x.left]
    return "".join(out)


def example(text: Rope | None, first: int, second: int, form: str, unit: re.Pattern) -> tuple[Rope | None, Rope | None, Rope | None]:
    """(example, prefix, middle)"""
    prefix, rest = split_units(text, first, unit)
    middle, suffix = split_units(rest, second - first, unit)
    parts = {"psm": (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), "spm": (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)}[form]
    out = None
    for part in parts:
        out = concatenated(out, leaf(part, 0) if isinstance(part, str) else part)
    return out, prefix, middle


def restored(text: str, form: str, unit: re.Pattern) -> str:
    """The text that an example was made of."""
    if form == "plain":
        return text
    marks = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    places = [text.index(m) for m in marks]
    parts, r = {}, rope(text, unit)
    for mark, place in reversed(list(zip(marks, places, strict=True))):
        r, part = split_points(r, place)
        parts[mark] = split_points(part, len(mark))[1]
    return spelled(concatenated(concatenated(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def _made(batches: Iterator[pa.RecordBatch], unit: re.Pattern, example_percent: int, spm_percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, digest in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            text, h = text.as_py(), [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
            r = rope(text, unit)
            n = r.units if r else 0
            if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= example_percent:
                out.append((n, "plain", None, None, text))
                continue
            form = "spm" if h[3] % 100 < spm_percent else "psm"
            made, prefix, middle = example(r, *sorted((h[0] % (n + 1), h[1] % (n + 1))), form, unit)
            out.append((n, form, prefix.points if prefix else 0, middle.points if middle else 0, spelled(made)))
        n, form, prefix, middle, texts = (list(x) for x in zip(*out, strict=True)) if out else ([],) * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, example_percent: int = EXAMPLE_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): form is psm, spm or plain, n the number of units."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("digest"))
    kind, unit = rows.schema["doc_id"].dataType.simpleString(), re.compile(UNIT)
    return rows.mapInArrow(lambda b: _made(b, unit, example_percent, spm_percent), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(examples: DataFrame, form_col: str = "form", output_col: str = "output") -> DataFrame:
    """The rows with their text in ``restored``; null outputs stay null."""
    unit = re.compile(UNIT)
    at, form = examples.columns.index(output_col), examples.columns.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else restored(t, f, unit) for t, f in zip(batch.column(at).to_pylist(), batch.column(form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "restored"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema.fields)
    return examples.mapInArrow(run, f"{columns}, restored string")
