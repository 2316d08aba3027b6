import hashlib
import random
import re

import pytest

from textmend.llm import fill_middle as fim

UNIT = re.compile(fim.UNIT)


def plain_version(doc_id, text, seed=7, share=100, spm=50):
    text = text or ""
    lines = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return len(lines), "plain", None, None, text
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (len(lines), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")))


def texts():
    rng = random.Random(5)
    some = ["".join(rng.choice(["a", "é", "😀", "\n", "\r", " ", "x" * 700]) for _ in range(rng.randrange(200))) for _ in range(150)]
    return [None, "", "\n", "\n\n", "no break", "holds <S> once", "<P", "<" * 9, "one\n" * 5000, "y" * 300_000 + "\nend", *some]


@pytest.mark.parametrize(("share", "spm"), [(100, 50), (60, 30), (0, 0)])
def test_equals_plain_version(spark, share, spm):
    rows = [(k % 170 if k else None, t) for k, t in enumerate(texts())] * 2
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, form string, n int")
    got = fim.restore(fim.fill_in_middle(df, example_percent=share, spm_percent=spm)).collect()
    want = [(d, *plain_version(d, t, 7, share, spm), t or "") for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_ropes_are_balanced_and_share_leaves():
    text = "".join(f"line {k}\n" for k in range(20_000))
    r = fim.rope(text, UNIT)
    assert (r.units, r.points) == (20_000, len(text))

    def leaves(x):
        return {id(x)} if x.text is not None else leaves(x.left) | leaves(x.right)

    rng, whole = random.Random(1), leaves(r)
    for _ in range(40):
        k = rng.randrange(20_001)
        a, b = fim.split_units(r, k, UNIT)
        again = fim.concatenated(a, b)
        assert fim.spelled(again) == text
        assert (a.units if a else 0) == k
        assert again.height <= 1.45 * len(whole).bit_length() + 2
        assert len((leaves(a) if a else set()) | (leaves(b) if b else set()) - whole) <= len(whole) + 2
        a, b = fim.split_points(r, k)
        assert fim.spelled(a) == text[:k]
        assert fim.spelled(b) == text[k:]


def test_empty_table_and_null_outputs(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, None, None), (2, "plain", "same")], "id long, form string, output string")
    assert [r.restored for r in fim.restore(df).orderBy("id").collect()] == [None, "same"]
