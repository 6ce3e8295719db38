"""Decontamination against plain edit distances, and planted passages."""

import random

import numpy as np

from tessera.llm import decontaminate as dc


def norm(t):
    raw = np.frombuffer(t.encode(), np.uint8)
    return dc.normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def edits(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != c), row[j] + 1, row[j - 1] + 1)
    return min(row)


def words(rnd, n):
    return " ".join("".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_normalise():
    assert norm("  The É-x,\n\n(y) ") == "the é x y".encode()


def test_windows_against_plain_alignment():
    rnd = random.Random(4)
    items = [(i, norm(words(rnd, rnd.randint(15, 45)))) for i in range(12)]
    index = dc.Index(items)
    for _ in range(40):
        n, t = rnd.choice(items)
        a = rnd.randrange(max(1, len(t) - 100))
        piece = bytearray(t[a : a + rnd.randint(60, 250)])
        for _ in range(rnd.randint(0, 14)):
            k = rnd.randrange(len(piece))
            piece[k : k + 1] = rnd.choice([b"", b"q", b"qx"])
        text = norm(words(rnd, 8) + " " + piece.decode(errors="ignore") + " " + words(rnd, 8))
        buf = np.frombuffer(text, np.uint8)
        got = {i for _, i, *_ in index.search(buf, np.array([0, len(buf)]))}
        want = {index.item[w] for w in range(len(index.text)) if edits(index.text[w].tobytes(), text) <= index.edits[w]}
        assert got == want


def test_planted(spark):
    rnd = random.Random(5)
    items = [words(rnd, 30) for _ in range(20)]
    schema = "doc_id long, text string, found string, item_id long"
    rows = []
    for d in range(60):
        body = words(rnd, 80)
        if d < 20:
            body = f"{body}\n{[str, str.upper, lambda s: s.replace(' ', ',  '), lambda s: s[:150]][d % 4](items[d])}. {words(rnd, 20)}"
        rows.append((d, body, None, 1))
    rows += [(60, None, "x", 1), (61, "", "x", 1), (62, items[3] * 3, None, None), (62, items[3], None, None)]
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "the"), (3, items[3])], "item_id long, text string")
    got = dc.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, d) for d in range(20)} | {(62, 3)}
    for r in got:
        if r.doc_id in (0, 4, 8):
            assert rows[r.doc_id][1].encode()[r.first_byte : r.end_byte].decode() == items[r.doc_id].strip(" .,")
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == {*range(20, 62)}
    assert dc.clean(docs, bench).columns == docs.columns
    assert dc.leaks(docs, bench.limit(0)).count() == 0 and dc.clean(docs, bench.limit(0)).count() == 64
    assert dc.leaks(docs.limit(0), bench).count() == 0


def found(items, text):
    buf = np.frombuffer(text, np.uint8)
    return {i for _, i, *_ in dc.Index(items).search(buf, np.array([0, len(buf)]))}


def test_any_excerpt_of_thirteen_words():
    rnd = random.Random(6)
    for n in (13, 14, 20, 38, 70):
        item = norm(words(rnd, n)).split()
        for a in range(n - 12):
            text = norm(words(rnd, 9)) + b" " + b" ".join(item[a : a + 13]) + b" " + norm(words(rnd, 9))
            assert found([(1, b" ".join(item))], text) == {0}, (n, a)
        assert found([(1, b" ".join(item))], norm(words(rnd, 60))) == set()
    item = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(150))
    for a in range(150 - 37):
        assert found([(1, item.encode())], item[a : a + 37].encode()) == {0}, a


def test_short_items(spark):
    items = ["What is the capital of France?", "Who was Ada", "Pi day?", "No", "nine char", "dine char", "...", None]
    bench = spark.createDataFrame([*enumerate(items), (8, "no!")], "item_id long, text string")
    texts = ["Q: what is  the capital of france -- Paris", "so who was ada", "on pi day", "A PI DAY.", "pi days, api day", "NO", "know, nor", "a nine-char b", "", None, "yes\nno", "Was it so? What is the capitol of France"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dc.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 1), (2, 2), (3, 2), (5, 3), (5, 8), (7, 4), (10, 3), (10, 8), (11, 0)}
    assert {r.doc_id: texts[r.doc_id][r.first_byte : r.end_byte] for r in got if r.item_id in (2, 4)} == {2: "pi day", 3: "PI DAY", 7: "nine-char"}
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == {4, 6, 8, 9}


def test_lower_case_of_all_scripts():
    for t in ("ÀÉÖ Œuvre ŠKODA", "ΟΔΥΣΣΕΙΑ ΆΓΙΟΣ", "МОСКВА Ёж", "ՀԱՅ", "Ａｂ", "ⰀⰁ", "𐐀𐐁", "İK日本"):
        low = "".join(c.lower() if len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) else c for c in t)
        assert norm(t) == low.encode()


def test_capitals_long_texts_and_parts(spark, monkeypatch):
    """Items over several parts of the benchmark, whichever part an item is in; passages in capitals of other scripts; a very long text."""
    items = [(i, f"вот текст номер {'абвгдежзик'[i]} о том как москва и волга встретились у моря {'лмнопрстуф'[i]} и пошли вместе дальше на север") for i in range(8)]
    rows = [(1, "... " + items[3][1].upper() + "!"), (2, "так и шло " * 400_000 + items[5][1] + " дальше " * 9), (3, "так и шло"), (4, None), (5, items[0][1] + "\n" + items[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as found", "2 as FOUND_")
    monkeypatch.setattr(dc, "PART", 300)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = list(dc.item_parts(bench, part=300))
    assert len(whole) > 2
    found = {(r.doc_id, r.item_id) for index in whole for r in dc.with_leaks(docs, index, "hits", keep=["doc_id"]).selectExpr("doc_id", "inline(hits)").collect() if r.edits == 0}
    assert found == {(1, 3), (2, 5), (5, 0), (5, 7)}
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]
