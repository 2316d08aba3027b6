"""SimHash near-duplicates through a Gray-ordered hierarchical index.

Pipeline: one fingerprint per document (Arrow tasks), distinct fingerprints, groups that agree on masked bits, a
Gray-ordered index inside each group, connected components by alternating star contraction.

Two settings of one search. ``near_duplicates`` links 64-bit fingerprints of at most ``max_bits`` differing bits, and
loses none: such codes agree on at least ``blocks - max_bits`` of ``blocks`` bit blocks, so every link lies inside a
group of codes that share such blocks. ``similar_documents`` takes 256-bit fingerprints of five-word shingles and
compares the shingle sets of those
whose angle may stand for a Jaccard similarity of 0.8: 46 bits, where nine of ten such pairs lie (the angle is
38.8 bits on average, give or take 5.7). So far apart no blocks need agree, and the groups share ``KEY_BITS`` bits
under each of ``KEYS`` masks drawn once. A pair of 0.8 meets in no group with probability (1 - 0.8485^16)^48 = 0.03, one
of 0.9 with less than 10^-4; documents with several copies have several ways into their group.

Groups above ``group_rows`` members are cut into chunks and every pair of chunks becomes a group of its own: no task
holds more than two chunks, whatever the number of copies.

Edge cases: null and empty texts have no words and fingerprint zero, and link like any other; fewer words than a
shingle make one shingle of all of them; repeated rows yield repeated result rows; a null id never becomes a
component id unless a component has no other; an empty table yields an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmend.llm.common import id_and_text, small_side, stored

WORDS, MAX_BITS, BLOCKS, GROUP_ROWS, LEAF, FAN = 4, 4, 6, 4096, 8, 4
#: Of ``similar_documents``: words of a shingle, similarity, lanes of 64 bits, bits that the codes of a group share, and
#: groups of a code.
SIMILAR_WORDS, SIMILARITY, LANES, KEY_BITS, KEYS = 5, 0.8, 4, 16, 48


def _mixed(x: np.ndarray) -> np.ndarray:
    """A second hash made from a first one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes, words: int = WORDS, lanes: int = 1) -> list[int]:
    """Signed 64-bit lanes of the SimHash of a UTF-8 text; A-Z are lower-cased, words are runs without ASCII white space.
    The first lane is made of the shingles' XXH64, each further one of the mixed hashes of the lane before."""
    tokens = text.lower().split()  # of bytes: both touch ASCII only
    if not tokens:
        return [0] * lanes
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[words - 1 :].tolist() if len(tokens) >= words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    out = []
    for lane in range(lanes):
        hashes = _mixed(hashes) if lane else hashes
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            part = hashes[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, lanes: int = 1) -> DataFrame:
    """(id, w0, w1, ...) for each row."""
    rows = id_and_text(docs, id_col, text_col)
    names = lane_names(lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())  # the same buffers
            found = np.array([fingerprint(t.as_py(), words, lanes) for t in texts], np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, k]) for k in range(lanes)]], names=["id", *names])

    return rows.mapInArrow(run, ", ".join([f"id {dict(rows.dtypes)['id']}", *[f"{w} bigint" for w in names]]))


def lane_names(lanes: int) -> list[str]:
    return [f"w{k}" for k in range(lanes)]


def gray_rank(lanes: list[str]) -> list[Column]:
    """Place of a code in the Gray sequence, highest lane first: the xor of all its right shifts, inverted below a lane of
    odd parity."""
    out, odd = [], None
    for name in lanes:
        code = F.col(name)
        for shift in (1, 2, 4, 8, 16, 32):
            code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
        if odd is not None:
            code = code.bitwiseXOR(F.negative(odd))
        odd = code.bitwiseAND(F.lit(1))
        out.append(code)
    return out


def _signed(mask: int, lanes: int) -> list[int]:
    parts = [mask >> (64 * k) & (1 << 64) - 1 for k in range(lanes)]
    return [m - (1 << 64) if m >> 63 else m for m in parts]


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[list[int]]:
    """Signed masks, each of blocks - max_bits bit blocks; two codes within max_bits agree under one of them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [_signed(sum(one[i] for i in c), 1) for c in combinations(range(blocks), blocks - max_bits)]


def drawn_masks(keys: int = KEYS, bits: int = KEY_BITS, lanes: int = LANES) -> list[list[int]]:
    """Signed masks of ``bits`` bits each, drawn once and for all."""
    rng = random.Random(1)
    return [_signed(sum(1 << b for b in rng.sample(range(64 * lanes), bits)), lanes) for _ in range(keys)]


def bits_of(similarity: float, lanes: int = LANES) -> int:
    """Differing bits that nine of ten pairs of sets of equal size and of this Jaccard similarity keep to: each bit differs
    with their angle's share of a half turn."""
    n, p = 64 * lanes, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(n * p + 1.2816 * math.sqrt(n * p * (1 - p)))


def angle_of(similarity: float, lanes: int = LANES) -> int:
    """Differing bits that such pairs have on average."""
    return int(64 * lanes * math.acos(2 * similarity / (1 + similarity)) / math.pi)


class GrayIndex:
    """Hierarchy over codes (rows of 64-bit lanes) in Gray order. A node keeps the bits all its codes share (mask, value);
    going up, nodes are merged in runs of ``fan``. Two nodes hold no link if their shared bits differ in more than
    max_bits places. Going down, only the bits that a level newly shares are compared and their differences are added
    to those gathered above, and whole pairs of groups are dropped by the sum."""

    def __init__(self, codes: np.ndarray, max_bits: int = MAX_BITS, leaf: int = LEAF, fan: int = FAN):
        self.codes, self.max_bits, self.leaf, self.fan = codes, max_bits, leaf, fan
        self.starts = np.arange(0, len(codes), leaf)
        ones, zeros = np.bitwise_and.reduceat(codes, self.starts, axis=0), np.bitwise_and.reduceat(~codes, self.starts, axis=0)
        self.levels = [(ones | zeros, ones)]
        while len(ones) > 1:
            at = np.arange(0, len(ones), fan)
            ones, zeros = np.bitwise_and.reduceat(ones, at, axis=0), np.bitwise_and.reduceat(zeros, at, axis=0)
            self.levels.append((ones | zeros, ones))

    def leaf_pairs(self, most: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that can hold a link, in bounded blocks: depth first from the root pair."""
        one = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, one, one, one, np.zeros((1, self.codes.shape[1]), np.uint64))]
        while stack:
            level, a, b, gathered, seen = stack.pop()
            if len(a) > most:
                for at in range(0, len(a), most):
                    stack.append((level, *(x[at : at + most] for x in (a, b, gathered, seen))))
                continue
            mask, value = self.levels[level]
            both = mask[a] & mask[b]
            gathered = gathered + np.bitwise_count((value[a] ^ value[b]) & both & ~seen).sum(axis=1)
            ok = gathered <= self.max_bits
            a, b, gathered, both = a[ok], b[ok], gathered[ok], both[ok]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            below, child = len(self.levels[level - 1][0]), np.arange(self.fan)
            x = (a[:, None, None] * self.fan + child[None, :, None]).repeat(self.fan, 2).ravel()
            y = (b[:, None, None] * self.fan + child[None, None, :]).repeat(self.fan, 1).ravel()
            parent = np.arange(len(a)).repeat(self.fan * self.fan)
            ok = (x < below) & (y < below) & (x <= y)
            stack.append((level - 1, x[ok], y[ok], gathered[parent[ok]], both[parent[ok]]))

    def forest(self) -> list[tuple[int, int]]:
        """Edges of a spanning forest of the link graph: fewer edges than codes, the same components."""
        n, size = len(self.codes), self.leaf
        label, edges = np.arange(n), []
        inside = np.arange(size)
        for a, b in self.leaf_pairs():
            low, high = np.minimum.reduceat(label, self.starts), np.maximum.reduceat(label, self.starts)
            open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))  # one component already: nothing to learn
            a, b = a[open_], b[open_]
            i = (a[:, None, None] * size + inside[None, :, None]).repeat(size, 2).ravel()
            j = (b[:, None, None] * size + inside[None, None, :]).repeat(size, 1).ravel()
            ok = (i < j) & (j < n)
            i, j = i[ok], j[ok]
            near = (np.bitwise_count(self.codes[i] ^ self.codes[j]).sum(axis=1) <= self.max_bits) & (label[i] != label[j])
            edges += joined(label, i[near], j[near])
        return edges


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """The links i - j that join components; label, a component's number for each code, is brought up to date."""
    if not len(i):
        return []
    pairs = np.sort(np.stack((label[i], label[j]), axis=1), axis=1)
    _, first = np.unique(pairs, axis=0, return_index=True)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k, (p, q) in zip(first.tolist(), pairs[first].tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(i[k]), int(j[k])))
    old = np.fromiter(parent, np.int64, len(parent))
    new = np.fromiter((find(x) for x in old.tolist()), np.int64, len(old))
    order = np.argsort(old)
    at = np.searchsorted(old[order], label)
    hit = (at < len(old)) & (old[order][np.minimum(at, len(old) - 1)] == label)
    label[hit] = new[order][at[hit]]
    return out


def _link_groups(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (g, lanes) come sorted by group and Gray rank; only the last, open group is carried from batch to batch. Groups
    of one leaf are compared all at once, larger ones by their index."""
    rest: tuple[np.ndarray, np.ndarray] | None = None

    def links(group: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(group[1:] != group[:-1]) + 1
        begin, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(group)]))
        size, label = np.repeat(end - begin, end - begin), np.arange(len(group))
        found: list[tuple[int, int]] = []
        for shift in range(1, LEAF):
            i = np.flatnonzero((group[:-shift] == group[shift:]) & (size[:-shift] <= LEAF))
            near = (np.bitwise_count(codes[i] ^ codes[i + shift]).sum(axis=1) <= max_bits) & (label[i] != label[i + shift])
            found += joined(label, i[near], i[near] + shift)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if b - a > LEAF:
                found += [(a + i, a + j) for i, j in GrayIndex(codes[a:b], max_bits).forest()]
        u, v = np.array(found, np.int64).reshape(-1, 2).T
        columns = [codes[side, k].view(np.int64) for side in (u, v) for k in range(codes.shape[1])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f"{s}{k}" for s in "uv" for k in range(codes.shape[1])])

    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(0).to_numpy(zero_copy_only=False)
        codes = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)], axis=1).view(np.uint64)
        if rest is not None:
            group, codes = np.concatenate((rest[0], group)), np.concatenate((rest[1], codes))
        closed = np.flatnonzero(group != group[-1])
        cut = int(closed[-1]) + 1 if len(closed) else 0
        if cut:
            yield links(group[:cut], codes[:cut])
        rest = group[cut:], codes[cut:]
    if rest is not None:
        yield links(*rest)


def link_edges(codes: DataFrame, masks: list[list[int]], max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """codes: distinct lanes. Edges (u, v) with the components of the whole link graph, a forest in each group. A group is
    known by a hash of its mask and masked bits; should two share a hash, they are compared as one and lose nothing."""
    lanes = codes.columns
    key = [F.xxhash64(F.lit(k), *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(lanes, mask, strict=True)]) for k, mask in enumerate(masks)]
    keyed = codes.select(F.explode(F.array(*key)).alias("g"), *lanes)
    large = stored(keyed.groupBy("g").count().where(F.col("count") > group_rows).select("g", F.ceil(F.col("count") / group_rows).cast("int").alias("parts")))
    if not large.isEmpty():
        dealt = keyed.join(small_side(large), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        chunk = F.pmod(F.xxhash64(*lanes), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64(F.col("g"), F.least(chunk, j), F.greatest(chunk, j)))
        keyed = dealt.select(F.explode(F.when(F.col("parts") == 1, F.array("g")).otherwise(pairs)).alias("g"), *lanes)
    ordered = keyed.repartition("g").sortWithinPartitions("g", *gray_rank(lanes))
    sides = [[f"{s}{k}" for k in range(len(lanes))] for s in "uv"]
    linked = ordered.mapInArrow(lambda b: _link_groups(b, max_bits), ", ".join(f"{c} bigint" for side in sides for c in side))
    return linked.select(*[_node(side).alias(s) for s, side in zip("uv", sides, strict=True)])


def _node(lanes: list[str]) -> Column:
    """A code as one value."""
    return F.col(lanes[0]) if len(lanes) == 1 else F.struct(*[F.col(w).alias(f"w{k}") for k, w in enumerate(lanes)])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for nodes that have an edge.

    Alternating star contraction. Each half round is a grouped minimum and a join on the node, so a node with very many
    neighbours is an aggregate with partial sums and a join whose skewed side Spark can split."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    found = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return found.unionAll(found.select("root").distinct().select(F.col("root").alias("node"), "root"))


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, masks: list[list[int]], max_bits: int, group_rows: int) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row."""
    lanes = lane_names(len(masks[0]))
    rows = stored(fingerprints(docs, id_col, text_col, words, len(lanes)))
    codes = stored(rows.groupBy(*lanes).agg(F.min("id").alias("least")))
    roots = components(link_edges(codes.select(*lanes), masks, max_bits, group_rows))
    linked = stored(codes.withColumn("node", _node(lanes)).join(roots, "node").select(*lanes, "least", "root"))
    smallest = stored(linked.groupBy("root").agg(F.min("least").alias("smallest")))
    # only codes that have a link meet their component's least id; a component of any size is a side that can be split
    joined_ids = stored(linked.join(small_side(smallest), "root").select(*lanes, "smallest"))
    by_code = codes.join(small_side(joined_ids), lanes, "left").select(*lanes, F.coalesce("smallest", "least").alias("component_id"))
    spelled = F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in lanes])
    return rows.join(by_code, lanes).select(F.col("id").alias("doc_id"), spelled.alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS,
                    blocks: int = BLOCKS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id): 64-bit fingerprints link at max_bits or fewer differing bits, all of them."""
    return grouped(docs, id_col, text_col, words, block_masks(blocks, max_bits), max_bits, group_rows)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles array<bigint>): the distinct shingles' hashes of each row (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                tokens = text.as_py().lower().split()
                out.append(np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(tokens[k : k + words]), 42) for k in range(max(1, len(tokens) - words + 1))] if tokens else [], np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.mapInArrow(run, "node string, shingles array<bigint>")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """pairs (u, v) of texts (node, text) with ``linked``: whether their sets of shingles are that similar. Only the texts of pairs
    are cut into shingles; texts without words are alike."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = stored(shingle_sets(texts.join(asked, "node").groupBy("node").agg(F.first("text").alias("text")), words))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    return stored(both.select("u", "v", (shared + 1e-9 >= similarity * (F.size("su") + F.size("sv") - shared)).alias("linked")))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY,
                      keys: int = KEYS, key_bits: int = KEY_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id): texts link where their sets of shingles are that similar.

    Candidates are the links of 256-bit fingerprints whose angle may stand for the similarity, a forest for each group, and the texts
    of one fingerprint. Each text of a component is confirmed on the sets against the component's most linked text, and if
    that fails against all its candidates. A text that has candidates but none confirmed is compared once more, with all texts
    of a group that it shares that are within the mean angle of the similarity, as the forest may have left out the right one."""
    lanes, masks, max_bits = lane_names(LANES), drawn_masks(keys, key_bits), bits_of(similarity)
    texts = id_and_text(docs, id_col, text_col).select("id", F.md5("text").alias("node"), "text")
    rows = fingerprints(texts.select(F.struct("id", "node").alias("both"), "text"), "both", "text", words, LANES)
    rows = stored(rows.select(F.col("id.id").alias("id"), F.col("id.node").alias("node"), *lanes))
    nodes = rows.select("node", *lanes).distinct()
    codes = stored(nodes.groupBy(*lanes).agg(F.min("node").alias("head")))
    alike = nodes.join(codes, lanes).where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
    forest = link_edges(codes.select(*lanes), masks, max_bits, group_rows).distinct()
    head = lambda c: codes.select(_node(lanes).alias(c), F.col("head").alias(f"h{c}"))
    linked = forest.join(head("u"), "u").join(head("v"), "v").select(F.least("hu", "hv").alias("u"), F.greatest("hu", "hv").alias("v"))
    pairs = stored(linked.unionAll(alike).distinct())
    named = texts.select("node", "text")
    # most of a group is confirmed against its most linked text; only the others need all their candidates
    degrees = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    member = stored(components(pairs).join(degrees, "node").select("node", "root", "n"))
    centres = stored(member.groupBy("root").agg(F.max(F.struct("n", "node")).alias("c")).select("root", F.col("c.node").alias("u")))
    stars = stored(member.join(small_side(centres), "root").where("u <> node").select("u", F.col("node").alias("v")))
    star = confirmed(stars, named, words, similarity)
    off = stored(star.where("not linked").select(F.col("v").alias("node")))
    ordered = stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    of_off = lambda c: pairs.join(small_side(off.withColumnRenamed("node", c)), c)
    rest = of_off("u").select("u", "v").unionAll(of_off("v").select("u", "v")).distinct().join(ordered, ["u", "v"], "left_anti")
    first = star.unionAll(confirmed(stored(rest), named, words, similarity))

    tried = first.select(F.explode(F.array("u", "v")).alias("node"), "linked").groupBy("node").agg(F.max("linked").alias("linked"))
    alone = stored(tried.where("not linked").select("node"))
    key = [F.xxhash64(F.lit(k), *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(lanes, mask, strict=True)]) for k, mask in enumerate(masks)]
    keyed = lambda df, node, mark: df.select(F.explode(F.array(*key)).alias("g"), F.col(node).alias(mark), *[F.col(w).alias(f"{mark}{k}") for k, w in enumerate(lanes)])
    near = keyed(nodes.join(small_side(alone), "node"), "node", "a").join(keyed(codes, "head", "b"), "g")
    bits = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(1, LANES)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    more = near.where((bits <= angle_of(similarity)) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    second = confirmed(stored(more.join(pairs, ["u", "v"], "left_anti")), named, words, similarity)

    roots = components(first.unionAll(second).where("linked").select("u", "v"))
    joined = stored(rows.select("id", "node").join(small_side(roots), "node").select("node", "id", "root"))
    smallest = stored(joined.groupBy("root").agg(F.min("id").alias("smallest")))
    ids = stored(joined.select("node", "root").distinct().join(small_side(smallest), "root").select("node", "smallest"))
    own = rows.groupBy("node").agg(F.min("id").alias("least"))
    by_node = own.join(small_side(ids), "node", "left").select("node", F.coalesce("smallest", "least").alias("component_id"))
    spelled = F.concat(*[F.lpad(F.lower(F.hex(w)), 16, "0") for w in lanes])
    return rows.join(by_node, "node").select(F.col("id").alias("doc_id"), spelled.alias("fingerprint"), "component_id")
