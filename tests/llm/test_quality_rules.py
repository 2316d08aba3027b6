import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.conftest import SF
from textmend.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if many[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


ODD = [(-1, None, None, None), (-2, "", "en", None), (-3, "a a a a a", "en", "s"), (-4, "\n\n a b\n a b\n#*|\t<>", "en", "s"), (-5, "x y z x y z " * 30, "de", "s"), (-6, "é ß w " * 80, "de", "s"), (-6, "é ß w " * 80, "de", "s")]


def test_counts_equal_the_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").union(spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string"))
    want = sorted((r.doc_id, *plain_counts(r.text)) for r in docs.collect())
    got = qr.apply_rules(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)


def plain_mcd(x, starts=30, steps=12):
    """Least log-determinant over random starts, each concentrated on exactly the nearest share of the rows."""
    rng, floors, best = np.random.default_rng(1), np.diag(np.array(list(qr.FLOORS.values())) ** 2), np.inf
    size = int(np.ceil(qr.SUBSET * len(x)))
    for _ in range(starts):
        near = x[rng.choice(len(x), 10, replace=False)]
        for _ in range(steps):
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) + floors
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[np.argsort(d)[:size]]
        best = min(best, np.linalg.slogdet(np.cov(near.T, bias=True) + floors)[1])
    return best


def mixed_rows(n=240):
    rng = random.Random(1)
    vocabulary = [f"w{i}" * (1 + i % 3) for i in range(4000)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 300)))
        if i % 12 == 0:
            text = " ".join(w.upper() + "$#" for w in text.split())
        rows.append((i, text, "en", "s" if i % 2 else "t"))
    return rows


def test_determinant_is_least_and_outliers_are_found(spark):
    rows, names = mixed_rows(), list(qr.FLOORS)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stats = qr.text_statistics(df).cache()
    found = {r.source: r for r in qr.estimates(stats.select("lang", "source", *names), names, prior=1e-9).collect()}
    for source in "st":
        x = np.array([[r[c] for c in names] for r in stats.where(stats.source == source).collect()])
        assert found[source].log_det <= plain_mcd(x) + 0.05
        lower = np.array([[found[source][f"w_{i}_{j}"] if j <= i else 0 for j in range(6)] for i in range(6)])
        assert -2 * np.log(np.diag(lower)).sum() == pytest.approx(found[source].log_det)
    got = {r.doc_id: r for r in qr.apply_rules(df).collect()}
    assert {i for i, r in got.items() if not r.kept} == {i for i in range(240) if i % 12 == 0}


def test_small_groups_are_measured_by_their_language(spark):
    """Outliers are outliers in a source of one row as in a source of hundreds."""
    rows = [(i, t, lang, "s" if i > 30 else f"own{i}") for i, t, lang, _ in mixed_rows()]
    got = {r.doc_id: r for r in qr.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {i for i, r in got.items() if not r.kept} == {i for i in range(240) if i % 12 == 0}


def test_empty_table_and_few_rows(spark):
    schema = "doc_id long, text string, lang string, source string, start string, kept int"
    assert qr.apply_rules(spark.createDataFrame([], schema)).collect() == []
    few = qr.apply_rules(spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(70)), "en", "s", "p", 1)], schema)).collect()
    assert [(r.kept, r.distance is not None) for r in few] == [(True, True)]


def test_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = qr.apply_rules(docs).join(labels, "doc_id").where("n_words >= 50")
    assert got.where("quality = 1 and not kept").count() <= 0.002 * got.count()
    assert got.where("quality = 0 and kept").count() <= 0.05 * got.where("quality = 0").count()
