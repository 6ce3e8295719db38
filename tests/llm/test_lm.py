"""Base scores by counting, lattice scores by listing every segmentation."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import lattice, lm, pieces
from tessera.runtime import Scratch

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def small():
    return lattice.Pieces(["▁a", "b", "ab", "▁ab", "ba", "aba", "é", "▁", "c"], [-float(i) for i in range(9)])


def segmentations(p, word, logp):
    ids = {b: i for i, b in enumerate(p.pieces)}

    def go(at):
        if at == len(word):
            yield []
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in ids:
                for rest in go(end):
                    yield [ids[word[at:end]], *rest]

    return [(s, sum(logp[i] for i in s)) for s in go(0)]


def test_forward_and_expected_uses(small):
    words = [b"abab", b"aba", "é".encode(), b"cab", b"b", b"zzab"]
    weight = np.array([3.0, 1, 2, 1, 5, 1])
    for at, m in lattice.by_length(words):
        got = small.forward(m, small.start)[:, -1]
        uses = small.expected(m, small.start, weight[at])
        want = np.zeros(len(small.pieces))
        for row, i in enumerate(at):
            every = segmentations(small, b" " + words[i], small.start)
            whole = np.logaddexp.reduce([x for _, x in every])
            assert abs(got[row] - whole) < 1e-9 and abs(small.long_word(b" " + words[i], small.start) - whole) < 1e-9
            for s, x in every:
                for j in s:
                    want[j] += weight[i] * math.exp(x - whole)
        assert np.allclose(uses, want)


def base(rows):
    train, docs = Counter(), 0
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            train.update((t or "").encode().lower().split())
            docs += 1
    n, v = sum(train.values()) + docs, len(train) + (docs > 0)
    out = []
    for d, t in rows:
        ts = [train[w] for w in (t or "").encode().lower().split()] + [docs]
        out.append((d, len(ts), sum(c > 0 for c in ts), n, sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in ts)))
    return out


def same(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want = sorted(base(rows), key=key)
    assert [r[:4] for r in mine] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in mine], [r[4] for r in want], rtol=1e-9)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lm.op7_lm(spark, sf).collect()
    same(got, rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and math.isfinite(r.score) and r.score < 0 for r in got)


def test_defined_results(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 60)
    rows = [(1, "The cat sat"), (2, None), (3, ""), (None, "the cat"), (5, "a " * 500 + "x" * 300), (5, "THE Cat sat éa"), (5, "THE Cat sat éa"), (9, " \t\n")]
    rows += [(i, f"the cat sat on the mat {i}") for i in range(20, 60)]
    schema = "doc_id long, text string, lang string, hash long, block int"
    df = spark.createDataFrame([(d, t, ["en", None][i % 2], 1, 2) for i, (d, t) in enumerate(rows)], schema)
    from tessera.llm.langid import held_out

    got = lm.score(df.withColumn("held_out", held_out("doc_id", 5)), PATH, Scratch(spark, "t")).collect()
    same(got, rows)
    assert all(math.isfinite(r.score) for r in got)
    none = df.withColumn("held_out", held_out("doc_id", 5))
    assert lm.score(none.limit(0), PATH, Scratch(spark, "t")).count() == 0
    alone = lm.score(none.selectExpr("doc_id", "text", "lang", "true as held_out"), PATH, Scratch(spark, "t")).collect()
    assert len(alone) == len(rows) and all(math.isfinite(r.score) and r.train_tokens == 0 and r.n_known == 0 for r in alone)


def test_long_words_train_like_short_ones(spark, monkeypatch):
    p = lattice.Pieces(["▁a", "b", "ab", "▁ab", "ba", "aba", "é", "▁", "c", "ばな"], [-float(i) for i in range(10)])
    words = [b"abab" * 30, b"cab", "ばな".encode() * 20]
    rows = spark.createDataFrame([(bytearray(w), 2 * i, 3) for i, w in enumerate(words)], "word binary, c0 long, c1 long")
    model = lm.Model(p, np.array([6.0, 9]), np.array([1.0, 1]), np.array([0.0, 0]))
    model.logp[1] = np.roll(model.logp[1], 7)
    model.shared = False
    got, spelled = lm.piece_uses(rows, model, 2)
    want, many = np.zeros((2, len(p.pieces))), np.zeros(2)
    for i, w in enumerate(words):
        m = np.frombuffer(b" " + w, np.uint8)[None]
        for k, c in ((0, 2.0 * i), (1, 3.0)):
            if c:
                c = model.spelled(k, np.array([c]), p.forward(m, model.logp[k])[:, -1])
                want[k] += p.expected(m, model.logp[k], c)
                many[k] += c[0]
    assert np.allclose(got, want) and np.allclose(spelled, many) and got[1, p.pieces.index("ばな".encode())] > 0


def plain(rows, path):
    """The whole model word by word: rows is (doc_id, lang, text, held out); natural logs throughout."""
    vocabulary = pieces.load(path)
    p = lattice.Pieces(list(vocabulary.score), [-vocabulary.score[t][0] for t in vocabulary.score])
    number = {b: i for i, b in enumerate(p.pieces)}

    def edges(word):
        return [(b, e, number[word[b:e]]) for e in range(1, len(word) + 1) for b in range(max(0, e - p.longest), e) if word[b:e] in number and (e - b > 1 or word[b:e] == word[b : b + 1])]

    def forward(word, logp):
        a = [0.0] + [-math.inf] * len(word)
        for b, e, i in edges(word):
            a[e] = np.logaddexp(a[e], a[b] + logp[i])
        return a

    def backward(word, logp):
        z = [-math.inf] * len(word) + [0.0]
        for b, e, i in reversed(edges(word)):
            z[b] = np.logaddexp(z[b], logp[i] + z[e])
        return z

    langs = sorted({r[1] for r in rows if not r[3]}, key=lambda x: (x is not None, x or ""))
    counts = {k: Counter(w for _, lang, t, held in rows if lang == k and not held for w in t.lower().encode().split()) for k in langs}
    docs = {k: sum(lang == k and not held for _, lang, _, held in rows) for k in langs}
    total = {k: sum(counts[k].values()) + docs[k] for k in langs}
    whole = {k: max(1 - (sum(c == 1 for c in counts[k].values()) + 1) / total[k], 0) for k in langs}
    logp = {k: p.start for k in langs}
    for _ in range(lm.ROUNDS):
        uses, spelled = {}, {}
        for k in langs:
            uses[k], spelled[k] = np.zeros(len(p.pieces)), 0.0
            for w, c in counts[k].items():
                word = b" " + w
                a, z = forward(word, logp[k]), backward(word, logp[k])
                known, spelt = whole[k] * (c - 1) / (total[k] - 1), (1 - whole[k]) * math.exp(a[-1])
                c *= spelt / (known + spelt)
                spelled[k] += c
                for b, e, i in edges(word):
                    uses[k][i] += c * math.exp(a[b] + logp[k][i] + z[e] - a[-1])
        every = sum(uses.values())
        for k in langs:
            u = uses[k] + lm.SMOOTH * (every / every.sum() * len(every) + 1) / 2
            logp[k], whole[k] = np.log(u / u.sum()), 1 - min((spelled[k] + 1) / total[k], 1)
    out = {}
    for d, _, t, _ in rows:
        each = []
        for k in langs:
            x = math.log(docs[k] / sum(docs.values())) + math.log(max(whole[k], 1 / total[k]) * docs[k] / total[k])
            for w in t.lower().encode().split():
                x += math.log(whole[k] * counts[k][w] / total[k] + (1 - whole[k]) * math.exp(forward(b" " + w, logp[k])[-1]))
            each.append(x)
        out[d] = np.logaddexp.reduce(each) / math.log(10)
    return out


def test_score_against_plain_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 90)
    monkeypatch.setattr(lm, "PLACES", 2)
    lines = ["the cat sat on the mat", "a dog and the cat", "the end of the day", "und der hund und die katze", "der hund bellt", "die katze", "le chien !!", "weiter und weiter"]
    rows = [(i, [None, "en", "de"][i % 3] if i % 7 else "de", f"{lines[i % 8]} {lines[(3 * i) % 8]} {'ab' * (i % 5)}", i % 5 == 1) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, held_out boolean")
    want = plain(rows, PATH)
    got = {r.doc_id: r.score for r in lm.score(df, PATH, Scratch(spark, "t")).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-3 * abs(want[d]) for d in want), [(got[d], want[d]) for d in want]
