"""The pipeline's stages, each on all that the stage before kept."""

import corpus_pipeline as cp
from tests.llm.test_neardup import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = []
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        after = {r.doc_id: r for r in rows}
        assert len(rows) == len(after) and all(before[d] == r for d, r in after.items())
        if name == "language":
            assert set(after) == set(before)
        if name == "quality":
            gone = set(before) - set(after)
            assert gone and not [d for d in gone if d in labels and labels[d].quality]
        if name == "near_duplicates":
            roots, _ = brute([(d, r.text) for d, r in before.items()], 5)
            assert set(after) == set(roots.values())
        if name == "decontamination":
            assert {d for d, r in before.items() if any(i in r.text for i in items)} == set(before) - set(after)
        docs = spark.createDataFrame(rows, docs.schema)
        seen.append(len(after))
    last = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == seen[-1] and all(len(r.ids) == r.n_tokens for r in last)
    assert cp.run(spark, sf).count() == len(last)


def test_defined_results(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, pred string, found int, ids int"
    rows = [(1, None, None, None, None, None, None, None), (2, "", "en", None, 0, "x", 1, 1), (3, "The cat and the dog", "en", "s", 1, None, 2, 2), (3, "The cat and the dog", "en", "s", 1, None, 2, 2), (None, "the cat and a dog", None, None, None, None, None, None)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == df.columns
            out.collect()
        cp.tokenised(spark, df, sf).collect()
    df = spark.createDataFrame(rows, schema)
    assert sorted(str(r.doc_id) for r in cp.one_of_each(spark, df, sf).collect()) == ["1", "2", "3", "None"]
    assert sorted(str(r.doc_id) for r in cp.language(spark, df, sf).collect()) == ["3", "3", "None"]


def test_rows_without_an_id_of_their_own(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = {x: " ".join(f"{x}{i}" for i in range(40)) for x in "abcdef"}
    near = texts["a"] + " more"
    rows = [(3, "a"), (3, "b"), (3, "b"), (None, "c"), (None, "d"), (None, "d"), (None, "b"), (None, "near"), (7, "e"), (5, "e"), (9, ""), (9, ""), (9, None), (8, ""), (None, ""), (None, ""), (None, "f")]
    make = lambda rows: spark.createDataFrame([(d, near if t == "near" else texts.get(t, t), "en", None, 1) for d, t in rows], schema)
    want = [(3, "a"), (3, "b"), (None, "c"), (None, "d"), (5, "e"), (9, None), (8, ""), (None, ""), (None, ""), (None, "f")]
    name = {v: k for k, v in texts.items()} | {near: "near"}

    def kept(rows):
        got = cp.one_of_each(spark, make(rows).repartition(3), sf).collect()
        return sorted(((r.doc_id, name.get(r.text, r.text) or "") for r in got), key=str)

    assert kept(rows) == sorted(((d, t or "") for d, t in want), key=str)
    # No doc_id repeats, and yet copies without one go.
    assert kept([(1, "a"), (None, "b"), (None, "b"), (None, "near")]) == sorted([(1, "a"), (None, "b")], key=str)
