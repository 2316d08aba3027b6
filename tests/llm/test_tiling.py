import random
import re

from textmend.llm import tiling

ITEMS = [(1, "the quick brown fox jumps over the lazy dog near the old river bank today"), (2, "Short one"), (3, None), (4, "!!"), (5, "the quick brown fox jumps over the lazy dog near the old river bank today")]


def plain_coverage(item, text, k=5):
    """Greedy tiling by trying every pair of places, word by word."""
    a, b = ([w.lower() for w in re.findall(r"\w+", x or "")] for x in (item, text))
    k, used_a, used_b, tiles = min(k, len(a)), set(), set(), []
    while k:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            break
        tiles.append(n)
        used_a.update(range(i, i + n))
        used_b.update(range(j, j + n))
    return sum(tiles), len(tiles)


def found(spark, docs, items=ITEMS, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return df, bench, sorted((r.doc_id, r.item_id, r.covered_words, r.n_tiles) for r in tiling.contaminated(df, bench, **more).collect())


def test_exact_reordered_and_clean(spark):
    docs = [
        (1, "Intro. The QUICK brown, fox jumps over the lazy dog; near the old river bank today!", "x"), (2, "near the old river bank today and the quick brown fox jumps over the lazy dog", "x"),
        (3, "the quick brown fox sat near the old river", "x"), (4, "a short\tone here", "x"), (5, None, "x"), (6, "", "x"), (2, "near the old river bank today and the quick brown fox jumps over the lazy dog", "x"),
    ]
    df, bench, got = found(spark, docs)
    assert got == [(1, 1, 15, 1), (1, 5, 15, 1), (2, 1, 15, 2), (2, 1, 15, 2), (2, 5, 15, 2), (2, 5, 15, 2), (4, 2, 2, 1)]
    left = tiling.decontaminate(df, bench)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 5, 6]


def test_tiles_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 30)))) for i in range(12)]
    docs = []
    for d in range(40):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 60))]
        cut = items[d % 12][1].split()
        half = len(cut) // 2
        docs.append((d, " ".join(words + cut[half:] + ["z"] + cut[:half] + words[:7]), ""))
    want = sorted((d, i, *plain_coverage(item, text)) for d, text, _ in docs for i, item in items if plain_coverage(item, text)[0] >= 0.6 * len(item.split()))
    assert found(spark, docs, items)[2] == want
    assert sorted(r for b in tiling.blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 40) for r in b) == items


def test_hash_paths_agree():
    text = "Ünï­code wörds " * 40
    words, first = tiling.word_hashes([text, "", "words"])
    assert list(first) == [0, len(words) - 1, len(words) - 1, len(words)]
    keep = tiling.SLICE_CHARS
    try:
        tiling.SLICE_CHARS = 100
        assert list(tiling.word_hashes([text, "", "words"])[0]) == list(words)
    finally:
        tiling.SLICE_CHARS = keep


def test_empty_tables(spark):
    assert found(spark, [])[2] == []
    assert found(spark, [(1, "a b c d e f", "")], [])[2] == []


def test_matches_do_not_depend_on_pieces(monkeypatch):
    """A repeated word meets itself in every place; small pieces leave the same maximal matches as one."""
    rng = random.Random(4)
    items = [(1, "a " * 60), (2, "a b " * 30), (3, " ".join(rng.choice("abc") for _ in range(80)))]
    texts = ["a " * 300, "b a " * 90, " ".join(rng.choice("abc") for _ in range(400)), "", "x y"]
    words, first = tiling.word_hashes(texts)
    seeds = tiling.Seeds(items)
    whole = [(t, i, sorted(found)) for t, i, found in seeds.matches(words, first)]
    assert whole
    for pairs in (1, 37, 1000):
        monkeypatch.setattr(tiling, "PAIRS", pairs)
        assert [(t, i, sorted(found)) for t, i, found in seeds.matches(words, first)] == whole
