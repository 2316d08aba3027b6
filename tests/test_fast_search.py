"""Search that scores less gives what search over everything gave."""

import random

import numpy as np

from textmend.operators import lookup as L
from textmend.operators import search as R


class Model:
    """Numbers that depend on the context and character alone, many of them equal."""

    def log_p(self, context, c):
        return -float((sum(map(ord, context)) * 7 + ord(c) * 3) % 6)


def greedy_over_all(model, text, t_insert=0.9, t_delete=0.9):
    seen, fixed = {}, set()
    while True:
        scored = [((p - t) / (1 - t), -i, merged, insert) for i, merged, insert, p in R.changes(model, text, seen) if merged not in fixed for t in (t_insert if insert else t_delete,)]
        best = max(scored, default=(0.0, 0, 0, False))
        if best[0] <= 0:
            return text
        text = R.changed(text, [(-best[1], best[3])])
        fixed.add(best[2])


def fewest_over_all(unigrams, text, longest=20):
    s = text.replace(" ", "")
    best = [(0, 0, -(1 << 60), 0)]
    for end in range(1, len(s) + 1):
        best.append(min((best[k][0] + (s[k:end] not in unigrams or end - k == 1 and s[k] not in "aAI0123456789.,;:!?"), best[k][1] + 1, max(best[k][2], -unigrams.get(s[k:end], 0)), k) for k in range(max(0, end - longest), end)))
    words, end = [], len(s)
    while end:
        start = best[end][3]
        words.append(s[start:end])
        end = start
    return " ".join(reversed(words))


def drawn(seed, size, letters="aab c"):
    draw = random.Random(seed)
    return "".join(draw.choice(letters) for _ in range(draw.randrange(size)))


def test_greedy_equals_greedy_over_all():
    for seed in range(300):
        text = drawn(seed, 40, "ab  cd")
        assert R.greedy(Model(), text, 0.6, 0.7) == greedy_over_all(Model(), text, 0.6, 0.7)


def test_greedy_of_a_long_text_ends():
    assert R.greedy(Model(), drawn(1, 2, "x") + "ab cd" * 8_000).replace(" ", "").endswith("abcd")


def test_segmentations_equal_those_over_all():
    for seed in range(300):
        draw = random.Random(seed)
        words = {drawn(seed * 50 + k, 6, "abcI") or "a": draw.randrange(1, 4) for k in range(8)}
        text = drawn(seed, 60, "abcI. d")
        heads = L.heads_of(words, 20)
        assert R.fewest_non_words(words, text, 20, heads) == R.fewest_non_words(words, text) == fewest_over_all(words, text)
        assert R.fewest_non_words(words, text, 3) == fewest_over_all(words, text, 3)
        pairs = {(a, b): 1 + len(a) for a in words for b in words if draw.random() < 0.3}
        assert R.viterbi(words, pairs, 30, text, 20, heads) == R.viterbi(words, pairs, 30, text)
        assert R.maximum_matching(words, text, None, sorted({len(w) for w in words if len(w) > 1}, reverse=True)) == R.maximum_matching(words, text)
        assert L.known_pairs_asked(20)({text}, words) == L.pairs_asked(L.word_spans(20))({text}, words)


def test_spans_found_are_those_of_the_table(spark):
    texts = ["the cat sat on the mat", "a\U0001f600b xyz" * 3, "q" * 5_000, ""]
    keys = ["the", "cat", "thecat", "\U0001f600b", "q" * 4_000, "nothere", "mat" * 2, "bxyz"]
    rows = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)], "chunk long, text string")
    table = spark.createDataFrame([(k, n + 1) for n, k in enumerate(keys)], "key string, cnt long")
    got = {(r.chunk, r.key, r.cnt) for r in L.found_spans(rows, "text", table).collect()}
    merged = [(k % 2, t.replace(" ", "")) for k, t in enumerate(texts)]
    assert got == {(c, k, n + 1) for n, k in enumerate(keys) for c, t in merged if k in t}
    short = {r.key for r in L.found_spans(rows, "text", table, 3).collect()}
    assert short == {"the", "cat", "\U0001f600b"}


def test_span_hashes_depend_on_the_span_alone():
    text = "abcabcxabc"
    h = L.span_hashes(text)(np.array([0, 3, 7, 6]), np.array([3, 6, 10, 9]))
    assert h[0] == h[1] == h[2] != h[3]
