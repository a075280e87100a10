"""Token operators against the libraries whose results they must give."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from geoloom.llm import byte_bpe, repair
from geoloom.llm.common import place
from geoloom.llm.queries import op2_token_file, op10_byte_bpe, tokenizer_file
from odd_rows import ODD_TEXTS

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def official(ranks):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def wild_texts(n):
    rng = random.Random(5)
    pool = [chr(c) for c in range(0x20, 0x7F)] * 3 + list(" \n\t\r\x0b\x1c\x1f\x85\xa0  　") * 4 + list("éßÀªº²½ⅣʰᾳİΣςñ한글日本語🙂👍🏽́‍​'") * 2
    pool += [chr(rng.randrange(0x100, 0x3000)) for _ in range(150)] + [chr(rng.randrange(0x10000, 0x1F000)) for _ in range(30)]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_byte_bpe_equals_the_official_encoder(ranks, official):
    own = byte_bpe.ByteBpe(ranks, P.PATTERN)
    for text in [*wild_texts(3000), *ODD_TEXTS, "aaaa" * 500, " " * 99 + "x", "x\n \ny  \n"]:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == official.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_byte_bpe_query(spark_text, documents, official):
    got = {r.doc_id: r for r in op10_byte_bpe(spark_text, FOLDER).collect()}
    assert len(got) == len(documents[1])
    for key, text in documents[1]:
        ids = np.array(official.encode_ordinary(text), "<u4")
        assert (got[key].n_tokens, got[key].ids_sha256) == (ids.size, hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_keeps_columns_and_rows(odd, none, ranks):
    out = byte_bpe.encode(odd.withColumnRenamed("lang", "ids"), ranks, P.PATTERN, out="ids_").collect()
    assert len(out) == odd.count() and {"ids", "ids_", "source"} <= set(out[0].asDict())
    assert [bytes(r.ids_) for r in out if r.text is None] == [b""]
    assert byte_bpe.digests(none, ranks, P.PATTERN).collect() == []


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def test_words_encode_as_whole_texts_do(words):
    own = repair.WordBpe(tokenizer_file("word_bpe_49k.json"))
    for text in [*wild_texts(3000), *ODD_TEXTS, "a" * 3000]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == words.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_file_query(spark_text, documents, words):
    got = {r.doc_id: r for r in op2_token_file(spark_text, FOLDER).collect()}
    start = 0
    for key, text in sorted(documents[1]):
        ids = np.array([*words.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, ids.size, zlib.crc32(ids.tobytes()))
        start += ids.size
    assert len(got) == len(documents[1])


def test_grammar_round_trip():
    rng = np.random.default_rng(3)
    cases = [np.zeros(0, int), np.ones(1, int), np.ones(5000, int), np.tile([1, 2, 3, 1, 2], 999), rng.integers(0, 40, 20_000), rng.zipf(1.3, 30_000) % 49_000]
    for ids in cases:
        seq, left, right, lengths = repair.compress(ids, 49_408)
        assert np.array_equal(repair.expand(seq, 49_408, left, right), ids)
        for k in range(len(left)):
            assert repair.expand(np.array([49_408 + k]), 49_408, left, right).size == lengths[k]
    assert len(repair.compress(np.ones(5000, int), 49_408)[0]) < 200


def test_token_file_reads_single_documents(spark_text, documents, words):
    path = place(spark_text)
    repair.write_tokens(documents[0], path, tokenizer_file("word_bpe_49k.json"), shard_tokens=3000)
    assert spark_text.read.parquet(path).count() > 20
    texts = dict(documents[1])
    got = {r.key: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in repair.read_tokens(spark_text, path, [0, 57, 199, 5000]).collect()}
    assert got == {k: [*words.encode(texts[k], add_special_tokens=False).ids, 1] for k in (0, 57, 199)}


def test_token_file_edge_rows(spark_text, odd, none):
    for df, n in ((odd, odd.count()), (none, 0)):
        path = place(spark_text)
        repair.write_tokens(df.withColumn("part", df.source), path, tokenizer_file("word_bpe_49k.json"))
        rows = sorted(repair.read_tokens(spark_text, path).collect(), key=lambda r: r.start)
        assert len(rows) == n
        assert [r.start for r in rows] == np.cumsum([0, *(len(r.ids) // 4 for r in rows)])[:n].tolist()
        assert not rows or rows[0].key is None
