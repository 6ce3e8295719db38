"""Licence scans against plain containment of every block."""

import random
import re

from tessera.llm import licences as lc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    """Every block of every template, one by one."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = [(i, label) for p, label in lc.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = []
    for label, t, tells in lc.TEMPLATES:
        said = re.findall(r"[a-z0-9]+", t.lower())
        tokens, width, run = set(said), -(-len(said) * 5 // 4), None
        if len(tokens & set(w)) < lc.CONTAINMENT * len(tokens) - 1e-9:
            continue
        for a in range(max(len(w) - width, 0) + 1):
            block = w[a : a + width]
            share = len(tokens & set(block)) / len(tokens)
            line = f" {' '.join(block)} "
            if share >= lc.CONTAINMENT - 1e-12 and all(f" {p} " in line for p in tells):
                run = [run[0] if run else a, min(len(w), a + width), max(share, run[2] if run else 0)]
            elif run:
                found.append((label, *run))
                run = None
        if run:
            found.append((label, *run))
    own = {x for _, x in places}
    return (len(w), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in found})), 1.0 if places else max((x[3] for x in found), default=0.0), sorted(found))


def same(got, text):
    want = brute(text)
    assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels, got.labels) == want[:6], text
    assert abs(got.score - want[6]) < 1e-9 and sorted((b.label, b.first_word, b.end_word, b.containment) for b in got.blocks) == want[7], text


def test_cases(spark):
    rnd = random.Random(2)
    texts = [None, "", " .. ", "MIT-License", "the mit\nLICENSE mit license", "permit license", "éMIT license", "general public License general public license", "apache license" * 3, "Apache 2.0 licensed, under the version"]
    for _, t, _ in lc.TEMPLATES:
        w = t.split()
        for cut in (0, 1, 2, 4):
            rest = [x for i, x in enumerate(w) if i not in rnd.sample(range(len(w)), min(cut, len(w) - 1))]
            texts.append(" ".join(rnd.choice(["foo", "bar", "the", "of"]) for _ in range(rnd.randint(0, 40))) + "\n" + " ".join(rest) + " tail" * rnd.randint(0, 9))
    texts.append("the " * 30_000 + lc.TEMPLATES[3][1] + " of" * 1000)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string, labels0 string, n long").withColumnRenamed("labels0", "source")
    for r in lc.scan_licences(df).collect():
        same(r, r.text)
    assert lc.scan_licences(df.limit(0)).count() == 0


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = lc.scan_licences(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).collect()
    assert len(got) == len(texts)
    for r in got:
        same(r, texts[r.doc_id])
    assert any(r.labels for r in got)


def test_labels_of_relatives(spark):
    gpl = next(t for x, t, _ in lc.TEMPLATES if x == "gpl-2.0" and len(t) > 100)
    cases = [
        ("Released under the Apache License", "apache"),
        ("Released under the BSD license.", "bsd"),
        ("Released under the MIT License.", "mit"),
        ("Licensed under CC BY 4.0, and once more: licensed under CC BY 4.0.", "cc-by-4.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
        (gpl, "gpl,gpl-2.0"),
        (gpl.replace("GNU General", "GNU Lesser General"), "gpl,lgpl"),  # its base phrase is in the other's name
        ("This work is licensed under the GNU General Public License, version 2.", "gpl,gpl-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("He was released under the bridge by the old licence.", ""),
    ]
    got = {r.text: r.labels for r in lc.scan_licences(spark.createDataFrame([(t,) for t, _ in cases], "text string")).collect()}
    assert got == dict(cases)


def test_edited_notices_at_any_place(spark):
    """Notices that keep just the needed share of words are found wherever they begin."""
    rnd = random.Random(8)
    rows = []
    for label, t, tells in lc.TEMPLATES:
        distinct, need, _ = lc.bounds((label, t, tells))
        spare = [x for x in distinct if not any(x in p.split() for p in tells)]
        for _ in range(6):
            gone = set(rnd.sample(spare, min(len(spare), len(distinct) - need)))
            rows.append((label, "zz " * rnd.randint(0, 200) + " ".join(x for x in lc.words(t) if x not in gone) + " yy" * rnd.randint(0, 200)))
    for r in lc.scan_licences(spark.createDataFrame(rows, "label string, text string")).collect():
        assert r.label in r.labels.split(","), (r.label, r.text)


def test_clashing_columns(spark):
    got = lc.scan_licences(spark.createDataFrame([("MIT License", 5, "x", "y")], "text string, SCORE int, labels string, other string"))
    assert got.select("score", "labels", "other").first()[:] == (1.0, "mit", "y")
