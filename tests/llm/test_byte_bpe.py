import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, q_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteBpe(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(4)
    bits = ["a", "'s", "'re", " ", "  ", "\n", "\xa0", "\x85", "\x1c", "\x1f", "é", "1", "²", "Ⅷ", "!", "中", "😀", "<|endoftext|>", "　", "\x00", "́", "_", "İ", "ſ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["a" * 3000, "ab" * 1000, " " * 700, "!" * 999, "<|endoftext|>" * 3, "".join(chr(rng.randint(97, 122)) for _ in range(2000))]


def test_ids_and_decoding_equal_the_library(codec, library):
    for t in odd_texts():
        theirs = library.encode(t, add_special_tokens=False).ids
        mine = codec.encode(t)
        assert mine.tolist() == theirs
        assert codec.decode(mine) == library.decode(theirs, skip_special_tokens=False)


def test_scan_and_heap_agree(codec):
    rng = random.Random(5)
    for n in (1, 2, 3, 50, 250):
        word = bytes(rng.randrange(97, 105) for _ in range(n))
        assert codec.merge(word) == codec._merge_long(word)


def test_all_documents_equal_the_library(spark, data, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in q_byte_bpe.query(spark, data).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, ids string, n_tokens string"
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (None, "hello", "x", "y"), (2, "", "x", "y")]
    got = byte_bpe.encode_digests(spark.createDataFrame(rows, schema), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 0), (2, 0), (2, 0)]
    assert got[0].ids_sha256 == hashlib.sha256(b"").hexdigest()
    full = byte_bpe.encode_documents(spark.createDataFrame(rows, schema), PATH).where("doc_id is null").first()
    assert (full.ids, full.decoded) == ([31373], "hello")
    assert byte_bpe.encode_digests(spark.createDataFrame([], schema), PATH).count() == 0
