import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cinderglass.llm.bpe import Codec, bpe_round_trip, default_path
from cinderglass.llm.token_store import Codes, op9_token_store, pack, read_tokens, write_tokens


@pytest.fixture(scope="module")
def codec():
    return Codec(default_path())


def odd_texts():
    rng = random.Random(5)
    texts = ["", " ", "\n\n  a", "it's we'll 'S ''s !'s", "x<|endoftext|> y<|endoftext", "日本語テキスト ½ ²3", "a b\u0085c\x1cd", "é" * 5000, "ab" * 9000, " " * 7000 + "x", "!?" * 4000, "\U0001f600" * 3000, "٣٤ ͸́e"]
    for _ in range(40):
        texts.append("".join(rng.choice(" \n\t'abcdéß½²!日 ­<|") for _ in range(rng.randrange(400))))
    for _ in range(6):
        texts.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéè日本") for _ in range(20000)))
    return texts


def test_encoding_is_the_librarys(codec):
    tok = Tokenizer.from_file(default_path())
    for text in odd_texts():
        want = tok.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(next(codec.encode([text])), "<u4")
        assert got.tolist() == want
        assert codec.decode(got) == tok.decode(want, skip_special_tokens=False)


def test_real_texts_go_through_joins(codec, monkeypatch):
    import duckdb

    tok = Tokenizer.from_file(default_path())
    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    before = codec.joins
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert codec.joins - before >= sum(max(0, -(-len(t) // 1024) - 1) for t in texts) > 1000
    from cinderglass.llm import bpe

    monkeypatch.setattr(bpe, "LEAF_CHARS", 7)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    for text in [*odd_texts()[:40], *texts[:60]]:
        assert np.frombuffer(next(codec.encode([text])), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_whole_table(spark):
    tok = Tokenizer.from_file(default_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in bpe_round_trip(docs, digests=True).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_round_trip_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x", 5), (1, "", "y", 6), (None, "a b", "z", 7)], "doc_id long, text string, ids string, n_tokens int")
    assert sorted((r.n_tokens, r.decoded) for r in bpe_round_trip(df).collect()) == [(0, ""), (0, ""), (2, "a b")]
    assert bpe_round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("high", [1, 200, 256, 70000, 1 << 32])
def test_codes(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
        codes = Codes(pack(ids))
        assert len(codes) == n and (codes.all() == ids).all()
        assert all(codes[int(i)] == ids[i] for i in rng.integers(0, n, 50)) if n else True


def test_store_equals_plain_encoding(spark):
    tok = Tokenizer.from_file(default_path())
    d = "/root/testdata/sf0.001"
    start, want = 0, {}
    for r in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op9_token_store(spark, d).collect()} == want


def test_store_of_odd_rows(spark):
    df = spark.createDataFrame([(2, None, 1), (1, "", 2), (1, "a", 3), (None, "b", 4)], "doc_id long, text string, start int")
    rows = [(r.doc_id, r.start, r.ids[-1], r.n_tokens) for r in read_tokens(write_tokens(df)).orderBy("start").collect()]
    assert rows == [(None, 0, 2, 2), (1, 2, 2, 1), (1, 3, 2, 2), (2, 5, 2, 1)]
    assert read_tokens(write_tokens(df.limit(0))).count() == 0
