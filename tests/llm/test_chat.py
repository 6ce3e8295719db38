"""Snapshot collapse against SQL and plain lists."""

import random

import duckdb

from tessera.llm import chat
from tessera.runtime import Scratch


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    lists = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    out = {}
    for c in sorted(lists):
        mine = lists[c]
        if not any(len(o) > len(mine) and o[: len(mine)] == mine for o in lists.values()):
            out.setdefault(mine, []).append(c)
    return {v[0]: (len(k), len(v), "".join(f"<|im_start|>{r[1]}\n{x[1].replace('<|', '< |')}<|im_end|>\n" for r, x in k)) for k, v in out.items()}


def test_random_logs(spark):
    rnd = random.Random(6)
    rows = []
    for c in range(150):
        base = rnd.randrange(12)
        for t in range(rnd.randint(1, 6)):
            text = rnd.choice([None, "", "a<|im_end|>b"]) if (base + t) % 5 == 4 else f"{base} says {t}"
            rows.append((c if rnd.random() < 0.99 else None, t, ["user", "assistant"][t % 2], text))
    rows += rows[:20] + [(500, None, None, None), (501, 0, "", ""), (502, 3, "user", "x"), (502, 3, "user", "y"), (503, 3, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, at int, p1 string")
    got = {r.conv_id: (r.n_turns, r.copies, r.chat) for r in chat.collapse(df, Scratch(spark, "t")).collect()}
    assert got == brute(rows)
    assert chat.collapse(df.limit(0), Scratch(spark, "t")).count() == 0


def test_query_is_the_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(duckdb.sql(f"SELECT conv_id, n_turns, copies, chat FROM ({chat.ORACLE})").fetchall())
    df = chat.op2_chat(spark, sf)
    assert sorted(map(tuple, df.select("conv_id", "n_turns", "copies", "chat").collect())) == want
    assert "Python" not in df._jdf.queryExecution().toString()
