"""Language identification: held-out accuracy, spans, and defined results."""

from itertools import product

import numpy as np

from tessera.llm import langid


def test_held_out_accuracy(spark, sf):
    want = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op1_language(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(want) and held
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_viterbi_is_the_best_path():
    rnd = np.random.default_rng(5)
    for _ in range(20):
        sizes = rnd.integers(0, 6, 4)
        at = np.concatenate([[0], np.cumsum(sizes)])
        word = rnd.normal(size=(at[-1], 3)).astype(np.float32) * 2
        got = langid.viterbi(word, at, 1.5)
        for a, b in zip(at[:-1], at[1:], strict=True):
            def value(path, a=a):
                return sum(float(word[a + i, s]) for i, s in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:], strict=False))
            if b > a:
                assert value(got[a:b]) >= max(value(p) for p in product(range(3), repeat=b - a)) - 1e-5


def test_spans_scripts_and_defined_results(spark):
    train = [("the cat and the dog with this thing " * 3, "en"), ("der hund und die katze nicht ein " * 3, "de"), ("это и что не на как " * 3, "ru")] * 4
    model = langid.fit(spark.createDataFrame(train, "text string, lang string").selectExpr("lang", "text", "1 as spans"))
    rows = [(1, "the dog with the cat and the thing. der hund und die katze nicht und der hund", "x"), (2, None, "x"), (3, "", "x"), (4, " 12 !!", "x"), (5, "что это", "x"), (6, "日本", "x"), (1, "THE " * 5000, "x"), (7, "\u0301 \u0301\u0302", "x"), (8, "\u0301the cat", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, model).collect()
    assert [r.lang_pred for r in got[1:5]] == ["und", "und", "und", "ru"] and got[6].lang_pred == "en"
    assert [s.lang for s in got[0].spans] == ["en", "de"] and got[0].spans[0].start == 0
    assert rows[0][1][got[0].spans[1].start :].startswith("der") and 0 < got[0].score < 1
    assert got[7].lang_pred == "und" and got[8].lang_pred == "en"
    assert got[5].score == 1 and got[1].score == 0 and got[1].spans == []
    none = langid.fit(df.select("lang", "text").limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_long_texts_in_parts(monkeypatch):
    rnd = np.random.default_rng(7)
    word = rnd.normal(size=(500, 4)).astype(np.float32) * 2
    want = langid.viterbi(word, np.array([0, 500]), 3.0)
    for part in (1, 7, 499, 500, 900):
        assert (langid.viterbi_long(lambda a, b: word[a:b], 500, 4, 3.0, part) == want).all()


def test_ties_many_languages_and_clashing_columns(spark, monkeypatch):
    same = [("abc abd", lang) for lang in ("zz", "aa", "mm")] * 2
    model = langid.fit(spark.createDataFrame(same, "text string, lang string"))
    got = langid.identify(spark.createDataFrame([("abc", 1, "x")], "text string, SCORE int, lang string"), model)
    assert got.select("lang_pred", "score", "lang").first()[:] == ("aa", 1.0, "x")
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = [(i, "der hund und die katze", "de") for i in range(9)] + [(i, "the dog and the cat", "en") for i in range(7)] + [(1, "le chien", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(langid.sample(docs)).langs == ["de", "en"]
    model = langid.fit(docs.where("lang != 'fr'"))
    texts = [t for _, t, _ in rows] + ["der hund und the cat and the dog " * 40, "", "12"]
    whole = model.label(texts)
    monkeypatch.setattr(langid, "CELLS", 64)  # parts of a few words
    assert model.label(texts) == whole and whole[0][:16] == ["de"] * 9 + ["en"] * 7
