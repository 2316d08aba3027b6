import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tests.conftest import SF
from textmend.llm import bpe


@pytest.fixture(scope="module")
def ranks(spark):
    return bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_documents_equal_the_library(spark, ranks, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "  \n\n  a  \t"), (-4, "!" * 3000 + "日本語 mañana ٣٤ 😀😀"), (-5, "<|endoftext|> it's" * 9), (-5, "a" * 5000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd)
    texts = {(r.doc_id, len(r.text or "")): r.text or "" for r in rows.collect()}
    got = bpe.encode_documents(rows, ranks, public_tokenizers.PATTERN).collect()
    assert len(got) == len(texts)
    by = {}
    for key, text in texts.items():
        by.setdefault(key[0], []).append(library.encode_ordinary(text))
    for r in got:
        assert r.ids in by[r.doc_id]
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(r.ids)).hexdigest()


def test_appends_and_edits_equal_fresh_encodings(vocabulary):
    rng = random.Random(2)
    for _ in range(60):
        data = bytes(rng.choice(b"the ation er in of re nd st\xc3\xa9 12") for _ in range(rng.randrange(1, 120)))
        grown = bpe.PrefixEncoding(vocabulary)
        for i in range(len(data)):
            grown.append(data[i : i + 1])
        a = rng.randrange(len(data) + 1)
        b = rng.randrange(a, len(data) + 1)
        new = bytes(rng.choice(b"thein") for _ in range(rng.randrange(5)))
        grown.replace(a, b, new)
        fresh = bpe.PrefixEncoding(vocabulary, data[:a] + new + data[b:])
        assert (grown.data, grown.last) == (fresh.data, fresh.last)
        assert bpe.decode(vocabulary, grown.ids()) == fresh.data.encode("latin-1")


def test_random_pieces_equal_the_library(vocabulary, library):
    rng = random.Random(4)
    for _ in range(400):
        piece = "".join(rng.choice("aeinrstlé") for _ in range(rng.randrange(1, 40)))
        assert bpe.encode_piece(vocabulary, piece.encode()) == library.encode_ordinary(piece)


def test_empty_table(spark, ranks):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), ranks, public_tokenizers.PATTERN).collect() == []


def test_file_format(tmp_path, spark):
    p = tmp_path / "x.tiktoken"
    p.write_bytes(base64.b64encode(b"a") + b" 0\n")
    assert bpe.read_ranks(spark, str(p)) == {b"a": 0}
