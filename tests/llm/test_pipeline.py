"""The stages against plain versions of each, on the smallest tables."""

import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline as pipeline
from tests.conftest import SF
from tests.llm.test_pii import FOUND
from tests.llm.test_quality_rules import plain_counts
from tests.llm.test_simhash import shingles
from textmend.llm import bpe, quality_rules


def plain_words(text):
    return " " + " ".join(re.findall(r"\w+", text.lower())) + " "


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in docs.collect()})
        assert k == 4 or docs.columns == columns
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    verdicts = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(kept[0]) == {i for i, ok in verdicts.items() if ok}
    assert not any(plain_counts(start[i])[-1] for i in kept[0])

    sets = {i: shingles(start[i] or "") for i in kept[0]}
    alike = lambda a, b, least: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    gone = set(kept[0]) - set(kept[1])
    assert gone and all(any(alike(i, j, 0.8) for j in sets if j != i) for i in gone)
    assert not any(alike(i, j, 0.8) for i in kept[1] for j in kept[1] if i < j)

    items = [plain_words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in kept[1] if not any(item in plain_words(start[i]) for item in items)}
    assert set(kept[2]) == clean and len(clean) < len(kept[1])

    assert set(kept[3]) == clean
    for i, r in kept[3].items():
        assert FOUND.sub("", r.text) == FOUND.sub("", start[i]) and r.n_chars == len(r.text)
        assert not set(FOUND.findall(start[i])) & set(FOUND.findall(r.text))

    ranks = bpe.read_ranks(spark, public_tokenizers.path(pipeline.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in kept[4].items():
        ids = library.encode_ordinary(kept[3][i].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(kept[3][i].text.encode()).hexdigest())
    assert sorted(tuple(r) for r in pipeline.run(spark, SF).collect()) == sorted(tuple(r) for r in kept[4].values())


def test_odd_rows_and_empty_tables(spark):
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, words, "en", "s", 5), (3, words, "en", "s", 5), (4, words, "en", "s", 5), (None, "other " + words[::-1], None, "s", 1)]
    for given, want in ((rows, [None, 3, 3]), ([], [])):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x)) == want
