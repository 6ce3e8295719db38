"""The Kneser-Ney model against one written out with dictionaries, and held-out labels."""

import math
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import quality
from tessera.runtime import Scratch


def brute(runs, order, symbols):
    """P(last | others) by interpolated modified Kneser-Ney, from a Counter of runs as tuples."""
    counts = {order: runs}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(r[1:] for r in counts[k + 1])
    cut = {}
    for k, c in counts.items():
        n = Counter(min(v, 5) for v in c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        cut[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) if n[i] and n[1] else min(0.5 * i, 1) for i in (1, 2, 3)]
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for r, v in c.items():
            after[k][r[:-1]].append(v)

    def p(run):
        k = len(run)
        if not k:
            return 1 / symbols
        seen = after[k].get(run[:-1])
        if not seen:
            return p(run[1:])
        v = counts[k].get(run, 0)
        g = sum(cut[k][min(x, 3)] for x in seen) / sum(seen)
        return (v - cut[k][min(v, 3)]) / sum(seen) + g * p(run[1:])

    return p


def test_against_dictionaries(spark):
    texts = ["the cat sat on the mat.", "The dog 12 and the cat, the end", "a", "on and on and on", "xyz", "日本語のテキスト、日本の本", "это и то"]
    model = quality.train(spark.createDataFrame([(t, 1) for t in texts], "text string, n long"), Scratch(spark, "t"))
    of = model.letters.of
    assert len({int(of[ord(c)]) for c in "".join(texts) if not c.isdigit()}) == len({c for c in "".join(texts) if not c.isdigit()})  # each its own symbol

    def symbols(t):
        return [0, 0, 0] + [int(of[quality._folded()[ord(c)]]) for c in t] + [0]

    runs = Counter(tuple(s[i : i + 4]) for t in texts for s in [symbols(t)] for i in range(len(s) - 3))
    p = brute(runs, 4, model.letters.size)
    for t in [*texts, "the rat", "", "QQQ ###", "日本 the", "x\0y", "本日のネコ"]:
        s = symbols(t.replace("\0", " "))
        want = sum(math.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3))
        got, n = model.score([t])
        assert n[0] == len(t) + 1 and abs(got[0] - want) < 1e-5 * (len(t) + 1)
    for before in runs:  # whatever stands before, the next symbol's probabilities make 1
        ctx = sum(x << 16 * (3 - i) for i, x in enumerate(before[1:]))
        assert abs(np.exp(model.log_p(np.array([ctx | x for x in range(model.letters.size)], np.uint64))).sum() - 1) < 1e-4
    assert model.score(["ab", "the cat"])[0][1] == model.score(["the cat"])[0][0]


def test_thresholds_are_plain_quantiles(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, ["en", "de", None, "fr"][min(int(rnd.integers(0, 40)) // 12, 3)], -float(x) * 30, 30) for i, x in enumerate(rnd.gamma(9, 0.3, 700))]
    good = [(i,) for i, *_ in rows if i % 3]
    mean = -2.5
    by_lang, overall = quality.thresholds(spark.createDataFrame(rows, "doc_id long, lang string, log_prob double, n_symbols long"), spark.createDataFrame(good, "doc_id long"), mean)

    def quantile(values):
        return sorted(values)[math.ceil(len(values) * quality.QUANTILE) - 1] * quality.MARGIN

    each = defaultdict(list)
    for i, lang, log, n in rows:
        if i % 3:
            each[lang].append(math.exp(-(log + mean * quality.DRAWN) / (n + quality.DRAWN)))
    every = quantile([x for v in each.values() for x in v])
    assert abs(overall - every) < 1e-9
    want = {k: quantile(v) if len(v) >= quality.OWN_ROWS else max(quantile(v), every) for k, v in each.items()}
    got = {r.lang: r.threshold for r in by_lang.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the cat sat " * 200_000, "a", "b", 3)], "doc_id long, text string, LOG_PROB string, n_symbols string, x int")
    model = quality.train(spark.createDataFrame([("the cat sat on the mat",)], "text string"), Scratch(spark, "t"))
    r = quality.perplexities(docs, model).select("doc_id", "log_prob", "n_symbols", "x").first()
    assert r.n_symbols == 2_400_001 and r.log_prob < 0 and r.x == 3


def test_table(spark, sf):
    sf = sf.replace("0.001", "0.01")  # enough labelled rows to speak of shares
    got = quality.op9_quality(spark, sf).collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    good = [r.kept for r in got if r.doc_id in labels and labels[r.doc_id].quality and not labels[r.doc_id].toxic]
    bad = [r.kept for r in got if r.doc_id in labels and not labels[r.doc_id].quality]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.35


def test_defined_results(spark):
    rows = [(1, "the cat sat", "en"), (2, "the cat sat", "en"), (3, None, "en"), (4, "", None), (5, "ZQ###" * 40, "xx"), (None, "the cat", None), (1, "the cat sat", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as code", "2 as p")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, None), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels, Scratch(spark, "t")).collect()
    assert len(got) == 7 and all(r.kept for r in got if r.doc_id != 5) and [r.kept for r in got if r.doc_id == 5] == [False]
    assert all(r.kept for r in quality.judge(docs, labels.limit(0), Scratch(spark, "t")).collect())
    assert quality.judge(docs.limit(0), labels, Scratch(spark, "t")).count() == 0


def test_every_trusted_document_is_used(spark, monkeypatch):
    n = 6000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, scratch: seen.append(sorted(r.doc_id for r in texts.collect())))
    _, others = quality.fit(docs, docs.selectExpr("doc_id", "1 as quality", "0 as toxic").where("doc_id != 7"), Scratch(spark, "t"))
    others = sorted(r.doc_id for r in others.collect())
    assert sorted(seen[0] + others) == [i for i in range(n) if i != 7] and len(set(seen[0])) == len(seen[0])
    assert abs(len(seen[0]) / n - quality.TRAIN_SHARE) < 0.03
