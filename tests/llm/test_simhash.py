import random
import re
import time

import numpy as np
import xxhash

from textmend.llm import simhash


def plain_fingerprint(text, words=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def plain_components(fps, max_bits=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(parent)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits:
                parent[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_fingerprint_equals_the_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 50):
        text = "".join(rng.choice(["a", "Bc", "É", "x"]) + rng.choice([" ", "\n", "\t  ", " "]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == [plain_fingerprint(text)]
        assert simhash.fingerprint(text.encode(), 4, 2)[0] == plain_fingerprint(text)


def test_forest_keeps_every_component():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for _ in range(900)]
    codes = np.unique(rng.choice(centres, 900) ^ np.array(flips, np.uint64))
    bin_of = {int(c): i for i, c in enumerate(codes)}
    gray = sorted(bin_of, key=lambda c: simhash_rank(c))
    codes = np.array(gray, np.uint64)
    parent = {int(c): int(c) for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    edges = simhash.GrayIndex(codes[:, None], leaf=8, fan=4).forest()
    assert len(edges) < len(codes)
    for i, j in edges:
        parent[find(int(codes[i]))] = find(int(codes[j]))
    want = plain_components([int(c) for c in codes])
    groups = lambda label: sorted(sorted(c for c in parent if label(c) == r) for r in {label(c) for c in parent})
    assert groups(find) == groups(lambda c: want[c])


def simhash_rank(code):
    for s in (1, 2, 4, 8, 16, 32):
        code ^= code >> s
    return code


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(0, None, "x"), (1, "", "x"), (2, "one two", "x"), (3, "ONE two", "x"), (None, "of a kind", "x")]
    for i in range(10, 90):
        words = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(40)) for _ in range(60)]
        rows.append((i, " ".join(words), "x"))
        if i % 3 == 0:
            words[rng.randrange(60)] = "changed"
            rows.append((i + 1000, " ".join(words), "x"))
        if i % 7 == 0:
            rows.append((i, " ".join(words), "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    want_fp = [(r[0], plain_fingerprint(r[1] or "")) for r in rows]
    roots = plain_components([f for _, f in want_fp])
    least = {}
    for i, f in want_fp:
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    want = sorted(((i, f"{f & (1 << 64) - 1:016x}", least.get(roots[f])) for i, f in want_fp), key=str)
    for rows_per_group in (4096, 3):
        got = simhash.near_duplicates(df, group_rows=rows_per_group).collect()
        assert sorted((tuple(r) for r in got), key=str) == want


def shingles(text, words=5):
    t = text.lower().split()
    return {tuple(t[i : i + words]) for i in range(max(1, len(t) - words + 1))}


def test_similar_documents_against_all_pairs(spark):
    """Of the pairs that brute force finds at a similarity of 0.8, at least 9 in 10 share a group; strangers share none."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "alpha beta gamma delta rho tau chi psi".split() for b in range(60)]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.choice([120, 300, 600]))]
        rows.append((10 * i, " ".join(text)))
        for k in range(1, rng.choice([1, 2, 5])):
            copy = list(text)
            for _ in range(round(len(text) * 0.018)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((10 * i + k, " ".join(copy)))
    rows += [(5001, None), (5002, ""), (5003, "too short"), (None, "too short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    assert of[5001] == of[5002] == 5001 and of[5003] == of[None] == 5003
    sets = {i: shingles(t) for i, t in rows if i is not None and i < 5000}
    pairs = [(a, b) for a in sets for b in sets if a < b and a // 10 == b // 10 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(pairs) > 100 and sum(of[a] == of[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(of[i] // 10 == i // 10 for i in sets)
    assert of == {r.doc_id: r.component_id for r in simhash.similar_documents(df, group_rows=3).collect()}


def test_gray_order_of_two_lanes(spark):
    """Neighbours in Gray order differ in one bit, over the edge of a lane too."""
    codes = [n ^ n >> 1 for n in range((1 << 64) - 4, (1 << 64) + 4)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, signed(c >> 64), signed(c & (1 << 64) - 1)) for k, c in enumerate(codes)], "k long, w0 long, w1 long")
    ranks = [[(x & (1 << 64) - 1) for x in r] for r in df.orderBy("k").select(*simhash.gray_rank(["w0", "w1"])).collect()]
    assert [(a << 64) + b for a, b in ranks] == list(range((1 << 64) - 4, (1 << 64) + 4))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == simhash.similar_documents(df).collect() == []


def test_similar_documents_leave_no_shuffled_files_behind(spark):
    """What its steps shuffle is removed at their end, not when the driver happens to collect its garbage."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {name.split("_")[1] for f in blocks.getAllFiles().mkString("\n").split("\n") if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")}
    text = " ".join(f"word{k}" for k in range(40))
    docs = spark.createDataFrame([(i, f"{text} end{i % 3}") for i in range(9)], "doc_id long, text string")
    before = shuffles()
    assert {r.component_id for r in simhash.similar_documents(docs).collect()} == {0}
    for _ in range(50):  # files are removed in the background
        left = shuffles() - before
        if len(left) <= 4:
            break
        time.sleep(0.1)
    assert len(left) <= 4  # those of the last step, which collect() runs
