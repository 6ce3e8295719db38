"""Logged conversations collapsed to the maximal ones, and rendered.

A log writes a growing conversation again and again, so most logged
conversations are prefixes of longer ones. Each turn gets the hash of all turns
up to it: the running exclusive-or of two 64-bit hashes of position, role and
text. A conversation is a prefix of a longer one if its last hash is the hash of
an earlier turn there; such ones go by an anti-join. Equal conversations give
one row with their number. The hashes are written once, without texts; only the
texts of what is kept are gathered and rendered.

Hashes are compared after grouping, so a conversation or first turn that a third
of the log repeats meets its copies as partial aggregates, not as rows.

Defined results: turns are in order of turn (null first), ties by role and text;
a row repeated within a conversation counts once; a null role or text differs
from an empty one but is rendered as empty; rows with a null conv_id belong to
no conversation and give no row; further columns are ignored. One rendered
conversation is one string, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.runtime import Scratch, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(log: DataFrame) -> DataFrame:
    """(conv_id, at, last, p1, p2): each turn's place from 1, whether it is the last, and the hash of all turns to it."""
    turns = log.where("conv_id is not null").select("conv_id", "turn", "role", "text").repartition("conv_id").dropDuplicates()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = (F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    turns = turns.select("conv_id", F.row_number().over(order).alias("at"), F.lead("conv_id").over(order).isNull().alias("last"), *(F.xxhash64(F.lit(k), *said).alias(f"h{k}") for k in (1, 2)))
    sofar = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select("conv_id", "at", "last", *(F.bit_xor(F.xxhash64("at", f"h{k}")).over(sofar).alias(f"p{k}") for k in (1, 2)))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): the smallest conv_id of each conversation that no longer one begins with."""
    ends = turns.where("last").groupBy("at", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = turns.where("not last").select("at", "p1", "p2").distinct()
    return ends.join(inner, ["at", "p1", "p2"], "left_anti").select("conv_id", F.col("at").alias("n_turns"), "copies")


def rendered(role: Column, text: Column) -> Column:
    """One turn; marks inside a text are broken up so that they cannot end it."""
    role, body = (F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |")) for c in (role, text))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), body, F.lit(CLOSE + "\n"))


def collapse(log: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, n_turns, copies, chat): the maximal conversations of a log, rendered."""
    keep = scratch.write(maximal(scratch.write(prefixes(log), "prefixes")), "kept")
    said = log.join(keep.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("said"))
    chat = F.array_join(F.transform("said", lambda t: rendered(t["role"], t["text"])), "")
    return said.join(keep, "conv_id").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "copies", chat.alias("chat"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations of ``conversations``, rendered."""
    return collapse(table(spark, sf_dir, "conversations"), Scratch(spark, "op2"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said, count(*) AS n_turns FROM t GROUP BY conv_id),
u AS (SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY said, n_turns)
SELECT conv_id, n_turns, copies,
  list_aggregate(list_transform(said, lambda x: '<|im_start|>' || replace(coalesce(x.r, ''), '<|', '< |') || chr(10) || replace(coalesce(x.t, ''), '<|', '< |') || '<|im_end|>' || chr(10)), 'string_agg', '') AS chat
FROM u AS a
WHERE NOT EXISTS (SELECT 1 FROM u AS b WHERE b.n_turns > a.n_turns AND b.said[1] = a.said[1] AND b.said[1:a.n_turns] = a.said)
"""
