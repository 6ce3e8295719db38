"""Encoding and decoding against the library itself."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return pieces.Codec(pieces.load(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


POOL = ["a", "b", " ", "  ", "▁", "\n", "\t", "\x00", "é", "日本", "😀", "the", "ing", "don't", "://", "...", ",", "<s>", "</s>", "<unk>", "<0x0A>", "ﬁ", "Ω", "123", "   ", "ß", "\r", "벨", "();", "́", "�"]


def test_random_texts_as_the_library(both):
    own, lib = both
    rnd = random.Random(7)
    for _ in range(4000):
        t = "".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 14)))
        want = lib.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(own.encode(t), "<u4").tolist() == want
        assert own.decode(np.array(want)).decode() == lib.decode(want)


def test_words_as_the_library(both):
    own, lib = both
    rnd = random.Random(8)
    for _ in range(4000):
        t = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABC019.,-_'éèüñ") for _ in range(rnd.randint(1, 40)))
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_bos=True, add_eos=True)


def test_any_ids_decode_as_the_library(both):
    own, lib = both
    rnd = random.Random(9)
    for _ in range(3000):
        ids = [rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(262) for _ in range(rnd.randint(0, 12))]
        assert own.decode(np.array(ids, np.int64)).decode() == lib.decode(ids)


def test_long_texts(both):
    own, lib = both
    for t in ("a" * 30_000, " " * 20_000, "ab" * 9000 + "\n" * 500, "thing" * 4000):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_bos=True, add_eos=True)


def test_table(spark, both):
    rows = [(1, "a b", "x"), (2, None, "x"), (3, "", None), (None, "a b", "x"), (1, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string")
    back = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in back) == [(0, "a b"), (1, "a b"), (1, "a b"), (2, ""), (3, "")]
    assert all(r.ids == both[1].encode(r.text or "", add_bos=True, add_eos=True) for r in back)
    assert pieces.round_trip(df.limit(0), PATH).count() == 0


def test_query(spark, sf, both):
    import hashlib

    got = {r.doc_id: r for r in pieces.op3_sentencepiece(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = both[1].encode(r.text or "", add_bos=True, add_eos=True)
        g = got.pop(r.doc_id)
        assert (g.n_tokens, g.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256(both[1].decode(ids).encode()).hexdigest()
    assert not got
