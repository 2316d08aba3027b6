import hashlib
import random
import re
import zlib

import pytest

from tests.conftest import SF
from textmend.llm import queries, runs


def brute(words, shortest=12):
    """All runs by trying every period, least first, and the words without what they repeat."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= shortest and not any(q % p == 0 and (s <= i and i + (j + q - i) <= s + length) for (s, length), p in found.items()):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    rows = sorted((s, length, p) for (s, length), p in found.items())
    gone = {k for s, length, p in rows for k in range(s + p, s + length)}
    return rows, " ".join(w for k, w in enumerate(words) if k not in gone)


def texts():
    rng = random.Random(3)
    out = [None, "", " \n", "a", "a " * 11, "a " * 12, "a\tb\n" * 6, "x " + "a b c " * 4, "a b " * 3 + "b a " * 9, "ü😀 ü " * 20]
    for _ in range(120):
        k, n = rng.randrange(1, 4), rng.randrange(1, 90)
        out.append(" ".join(rng.choice("abc"[:k]) for _ in range(n)))
    for _ in range(40):  # powers with changes
        unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 30))]
        words = [rng.choice("xyz") for _ in range(rng.randrange(9))] + unit * rng.randrange(2, 6) + unit[: rng.randrange(len(unit))]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "!"
        out.append(" ".join(words))
    fib = ["a", "b"]
    while len(fib) < 400:
        fib = fib + fib[: max(1, int(len(fib) / 1.618))]
    return [*out, " ".join(fib), " ".join("ab"[bin(k).count("1") % 2] for k in range(256))]


@pytest.mark.parametrize("shortest", [12, 2])
def test_equals_brute_force(spark, shortest):
    rows = [(k // 2 if k else None, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], "doc_id long, text string, runs int, words string").repartition(3)
    got = runs.periodic_runs(df, shortest=shortest).collect()
    want = []
    for d, t in rows:
        words = re.findall(runs.WORD, t or "")
        found, kept = brute(words, shortest)
        want.append((d, len(words), found, kept))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str) == sorted(want, key=str)


def test_one_by_one_and_many_at_once_agree(spark):
    rows = [(k, t) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {r.doc_id: r for r in runs.periodic_runs(df).collect()}
    for k, t in rows:
        assert [tuple(x) for x in want[k].runs] == [tuple(x) for x in runs.runs_of([re.findall(runs.WORD, t or "")], 12)[0].tolist()]


def test_long_text():
    rng = random.Random(8)
    words = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)]
    found = runs.runs_of([words[:30_000] + words[10_000:30_000] * 3 + ["end"]], 12)[0].tolist()
    assert [10_000, 80_000, 20_000] in found


def test_query_on_the_given_table(spark):
    got = {r.doc_id: r for r in queries.op12_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for d, text in docs:
        words = re.findall(runs.WORD, text or "")
        h, n = zlib.crc32(str(d).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        if n > 700:
            continue  # the plain version takes n^2
        found, kept = brute(words)
        r, best = got[d], min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 5


def test_empty_table(spark):
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
