"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of shard loads. Differencing takes the two with
the largest spread (largest less smallest load), adds the loads of one in
falling to those of the other in rising order, and puts the result back, until
one is left. Groups go by hash into pieces of bounded size, each piece is
differenced in one task, and the pieces' partial partitions, a row of loads
each, are differenced in turn; so neither the driver nor a task holds more than
PIECE groups or the pieces' loads.

Texts that are equal stay together, whatever their number. Defined results: null
and empty texts are two groups of their own, of 8 bytes a row; ties are broken
by a group's hash; repeated rows are rows of their own; an empty table has no
rows; further columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.runtime import Scratch, ship, table

#: Groups differenced in one task, about.
PIECE = 20_000
#: Rows numbered in one task, about.
CHUNK = 1_000_000


def difference(parts: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combines partial partitions, each a list of k loads.

    Returns the final loads in falling order and, for each part, where each of
    its loads went: a position in the final loads.
    """
    k = len(parts[0])
    # A node is (loads in falling order, for each load the leaves (part, position) or nodes it is made of).
    heap = []
    for i, loads in enumerate(parts):
        order = sorted(range(k), key=lambda j: -loads[j])
        fall = [loads[j] for j in order]
        heap.append((fall[-1] - fall[0], i, fall, [(i, j) for j in order]))
    heapq.heapify(heap)
    number = len(parts)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = [(a[j] + b[k - 1 - j], j) for j in range(k)]
        both.sort(key=lambda p: -p[0])
        fall = [p[0] for p in both]
        heapq.heappush(heap, (fall[-1] - fall[0], number, fall, [[x[j], y[k - 1 - j]] for _, j in both]))
        number += 1
    _, _, loads, tree = heap[0]
    went = [[0] * k for _ in parts]
    for place, root in enumerate(tree):
        stack = [root]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                went[node[0]][node[1]] = place
            else:
                stack += node
    return loads, went


def place_groups(sizes: list[int], k: int) -> tuple[list[int], list[int]]:
    """(loads of k bins in falling order, the bin of each size): differencing of single sizes.

    A fresh size has one load and k - 1 empty ones, which only the first few
    combinations keep; those are held as short lists.
    """
    heap = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    children: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            both = [*zip(a, x, strict=True), *zip(b, y, strict=True)]
        else:
            both = []
            shift = k - len(b)  # b in rising order stands against a, empty loads first
            for j in range(k):
                u = (a[j], x[j]) if j < len(a) else None
                v = (b[k - 1 - j], y[k - 1 - j]) if j >= shift else None
                if u and v:
                    children[number] = (u[1], v[1])
                    both.append((u[0] + v[0], number))
                    number += 1
                elif u or v:
                    both.append(u or v)
        both.sort(key=lambda p: -p[0])
        loads = [p[0] for p in both]
        heapq.heappush(heap, ((loads[-1] if len(loads) == k else 0) - loads[0], number, loads, [p[1] for p in both]))
        number += 1
    out = [0] * len(sizes)
    loads, roots = (heap[0][2], heap[0][3]) if heap else ([], [])
    for place, root in enumerate(roots):
        stack = [root]
        while stack:
            n = stack.pop()
            if n in children:
                stack += children[n]
            else:
                out[n] = place
    return loads + [0] * (k - len(loads)), out


def byte_shards(rows: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """(key, shard) for each group of ``rows`` (columns key, size): sums of size nearly equal over the shards."""
    ship(rows.sparkSession)
    groups = scratch.write(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    n = groups.count()
    # Pieces hold about sqrt(n) groups once there are many, so that neither step is long.
    pieces = max(1, -(-n // PIECE))
    groups = groups.withColumn("piece", F.pmod(F.xxhash64("key"), F.lit(pieces)).cast("int"))

    def one(t: pa.Table) -> pa.Table:
        order = pc.sort_indices(t, sort_keys=[("size", "descending"), ("key", "ascending")])
        t = t.take(order)
        loads, bins = place_groups(t["size"].to_pylist(), shards)
        return pa.table({"piece": t["piece"], "key": t["key"], "bin": pa.array(bins, pa.int32()), "size": t["size"]})

    binned = scratch.write(groups.groupBy("piece").applyInArrow(one, "piece int, key string, bin int, size long"), "binned")
    sums = binned.groupBy("piece", "bin").agg(F.sum("size").alias("load"))
    final = _combine(scratch.write(sums, "loads"), shards, scratch)
    return binned.join(F.broadcast(final) if pieces * shards <= 1_000_000 else final, ["piece", "bin"]).select("key", "shard")


def _combine(loads: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """(piece, bin, shard): the pieces' loads differenced, at most PIECE pieces in one task, in rounds."""
    schema = "top int, piece int, bin int, shard int"

    def one(t: pa.Table) -> pa.Table:
        p, b, v = (t[c].to_numpy() for c in ("piece", "bin", "load"))
        names, at = np.unique(p, return_inverse=True)
        parts = np.zeros((len(names), shards), np.int64)
        parts[at, b] = v
        _, went = difference(parts.tolist())
        went = np.array(went)
        return pa.table({"top": t["top"], "piece": t["piece"], "bin": t["bin"], "shard": pa.array(went[at, b], pa.int32())})

    pieces = loads.agg(F.max("piece").alias("m")).first().m
    tops = max(1, -(-((pieces or 0) + 1) // PIECE))
    placed = loads.withColumn("top", (F.col("piece") % tops).cast("int")).groupBy("top").applyInArrow(one, schema)
    if tops == 1:
        return placed.select("piece", "bin", "shard")
    placed = scratch.write(placed, "placed")
    higher = placed.join(loads, ["piece", "bin"]).groupBy(F.col("top").alias("piece"), F.col("shard").alias("bin")).agg(F.sum("load").alias("load"))
    above = _combine(scratch.write(higher, "loads"), shards, scratch).toDF("top", "mid", "final")
    return placed.withColumnRenamed("shard", "mid").join(above, ["top", "mid"]).select("piece", "bin", F.col("final").alias("shard"))


def with_slots(rows: DataFrame, scratch: Scratch, by: str = "shard") -> DataFrame:
    """``rows`` with the column slot, 0, 1, 2 ... within each value of ``by``.

    Rows of a shard are numbered in chunks, each of which begins where those
    before it end, so no shard is numbered in one task. Rows are dealt to chunks
    by where they stand, not by what they hold, so copies spread as well; for that
    they are written once.
    """
    rows = scratch.write(rows.withColumn("_at", F.monotonically_increasing_id()), "placed")
    chunks = max(1, -(-rows.count() // CHUNK)) * 4
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("_at", F.lit(5)), F.lit(chunks)).cast("int"))
    sizes = rows.groupBy(by, "_chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(by, "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    number = Window.partitionBy(by, "_chunk").orderBy("doc_id", "key", "_at")
    rows = rows.withColumn("_row", F.row_number().over(number))
    return rows.join(begins, [by, "_chunk"]).withColumn("slot", F.col("_begin") + F.col("_row") - 1).drop("_at", "_chunk", "_begin", "_row")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes; equal texts stay in one shard."""
    scratch = Scratch(spark, "op4")
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("key"),
    )
    rows = scratch.write(rows, "rows")
    out = with_slots(rows.join(byte_shards(rows, 24, scratch), "key"), scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
