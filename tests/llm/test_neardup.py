"""Near duplicates against all pairs compared by brute force."""

import re

from tessera.llm import neardup
from tessera.llm.components import components
from tessera.runtime import Scratch, likely

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute(rows, width=2, percent=80):
    """Components by doc_id: rows is a list of (doc_id, text)."""
    sets = [(d, shingles(t, width)) for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, o in sets[:i]:
            if s and o and 100 * len(s & o) >= percent * len(s | o):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}, {d: len(s) for d, s in sets}


def check(spark, rows, width=2):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n long".replace("n long", "rep string"))
    got = neardup.near_duplicates(df, Scratch(spark, "t"), width=width).collect()
    want, sizes = brute(rows, width)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_small_cases(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(10, " ".join(base)), (3, " ".join(base).upper()), (4, " ".join(base[:55] + ["x"] * 3)), (5, None), (6, ""), (7, " \t\n"), (8, "One"), (9, "oNE"), (11, "one two"), (12, "Éa ÉA"), (13, "éa éa"), (14, "one two")]
    # A chain in which only neighbours are linked.
    for k in range(6):
        rows.append((20 + k, " ".join([f"c{i}" for i in range(5 * k, 5 * k + 80)])))
    check(spark, rows)


def test_group_of_near_copies(spark):
    import random

    rnd = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = f"r{rnd.random()}"
        rows.append((d, " ".join(w)))
    check(spark, rows)
    check(spark, rows, width=5)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in neardup.op5_minhash(spark, sf).collect()}
    assert got == brute(docs)[0]


def test_nulls_repeats_and_empty_table(spark):
    schema = "text string, doc_id long, keys long"
    df = spark.createDataFrame([("a b c d", None, 1), ("a b c d", 5, 1), ("a b c d", 4, None), ("q r", 9, 1), ("a b c d", 9, 1), (None, 9, 1), ("zz zy", None, 2)], schema)
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in neardup.near_duplicates(df, Scratch(spark, "t"), width=2).collect()), key=str)
    assert got == [("4", 4, True), ("5", 4, False), ("9", 4, False), ("9", 4, False), ("9", 4, False), ("None", 4, False), ("None", None, True)]
    assert neardup.near_duplicates(df.limit(0), Scratch(spark, "t")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (None, 3), (7, None)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, **{i: 300 for i in range(300, 340)}}


def test_boilerplate_families(spark):
    """Texts of one frame with their own words: buckets in common, few links."""
    import random

    rnd = random.Random(5)
    frame = [f"f{i}" for i in range(120)]
    rows = []
    for d in range(150):
        own = [f"o{d}_{i}" for i in range(rnd.randint(18, 45))]
        rows.append((d, " ".join(frame + own)))
        if d % 5 == 0:
            rows.append((1000 + d, " ".join(frame[2:] + own)))
    rnd.shuffle(rows)
    check(spark, rows)
    check(spark, rows, width=5)


def test_lists_in_blocks(spark, monkeypatch):
    """Small blocks, so that lists are cut."""
    import random

    rnd = random.Random(6)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    monkeypatch.setattr(neardup, "PIVOTS", 3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for d in range(90):
        w = list(base)
        for _ in range(rnd.randint(4, 9)):
            w[rnd.randrange(len(w))] = f"r{rnd.random()}"
        rows.append((d, " ".join(w)))
    check(spark, rows)


def _cloud(n, seed):
    """n texts of one frame with a few words changed: most pairs are nearly, but not, linked."""
    import random

    rnd = random.Random(seed)
    rows = []
    for d in range(n):
        w = [f"w{i}" for i in range(120)]
        for at in rnd.sample(range(120), rnd.randint(8, 11)):
            w[at] = f"r{d}_{at}"
        rows.append((d, " ".join(w)))
    return rows


def test_cloud_makes_no_table_of_pairs(spark, monkeypatch):
    made = {}
    write = Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        if name in ("left", "compared", "pairs of blocks"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    check(spark, _cloud(240, 7))
    assert made["left"] > 150
    assert made["compared"] + made["pairs of blocks"] <= 16 * made["left"]


def test_long_lists_in_blocks(spark, monkeypatch):
    """Long lists taken together, with a large component, small ones and single texts, in small blocks."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 20)
    monkeypatch.setattr(neardup, "PIVOTS", 5)
    rows = _cloud(70, 8)
    rows += [(100 + d, " ".join(t.split()[:117])) for d, t in rows[::2]] + [(200 + d, t + f" x{d} y{d} z{d} u{d}") for d, t in rows[:20]]
    rows += [(300 + d, " ".join([f"w{i}" for i in range(120 - d % 7)] + [f"v{d}_{i}" for i in range(d % 5)])) for d in range(40)]
    for merged in (0, 4):
        monkeypatch.setattr(neardup, "MERGED", merged)
        check(spark, rows)


def test_long_text(spark):
    words = [f"w{i}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[20_000:])), (3, " ".join(words[:40_000])), (4, "x" * 5_000_000)]
    check(spark, rows)


def test_candidates_are_not_broadcast_as_rows(spark):
    docs = spark.range(-500, 300_000).selectExpr("if(id % 1000 = 999, null, id) as doc_id", "cast(id as string) as text")
    ids = spark.range(0, 300_000, 2).selectExpr("if(id = 10, null, id) as rep")
    found = likely(docs, ids)
    got = found.collect()
    want = {i for i in range(0, 300_000, 2) if i != 10}
    here = {r.doc_id for r in got}
    assert want <= here and None not in here and found.columns == ["doc_id", "text"] and len(got) == len(here)
    assert len(here - want) < 0.05 * 150_000
    assert likely(docs, ids.limit(0)).count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "bitmap_construct_agg" in plan and "SortMergeJoin" not in plan
