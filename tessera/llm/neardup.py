"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first scatters a shingle
over the universe, and coordinate k is the least value that the second, shifted
circularly by k, gives any shingle. Shifting by k means reading k places further
on, so a shingle's coordinates are one contiguous slice of a table. Bands of
coordinates put documents into buckets; pairs from buckets are confirmed on the
full shingle sets.

Documents with equal sets form a class, and only classes are compared. In each
bucket every class is compared with a pivot, and links join classes to
components. The classes of buckets that then still hold several components are
compared exactly, but not with all others: with shingles in order of how many of
these classes have them, the rarest first, two classes can only be linked if they
share one of the first n - need + 1 (need: the share of n that a link asks for).
So each such shingle has a list of classes, mostly none or one: classes that share
no more than boilerplate never meet. A short list gives its pairs, so a class never
has more of them than its lists are long. Long lists give none: those of much the
same classes are taken together as one, and what then still holds several
components is cut into blocks. Two blocks of bounded size are compared in one task,
which gives only links that join components; classes of the list's least component
meet only those outside it.

Defined results: null, empty and blank texts have no shingles and are linked
with nothing; rows that share a doc_id count as one document; rows with a null
doc_id can be linked but never name a component; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm import scan
from tessera.llm.components import components
from tessera.llm.scan import U, extend, utf8
from tessera.runtime import Scratch, likely, ship, table

#: A pair at a similarity of exactly 0.8 shares no band with a probability of (1 - 0.8**6)**56, about 4e-8.
BANDS, ROWS = 56, 6
UNIVERSE = 1 << 20
#: Classes and shingles in a block of a list, about.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
#: A list of at most so many sets gives all its pairs (each set is a pivot); longer ones are compared in blocks.
PIVOTS = 64
#: A long list is taken together with others if all their sets are at most so many times its own.
MERGED = 4
#: Bytes of text whose words a worker hashes at once; its arrays are some hundred times as large.
BLOCK = 1 << 18


def _permutation(seed: int) -> np.ndarray:
    return np.argsort(scan.stream(seed, UNIVERSE), kind="stable").astype(np.uint32)


class Sketcher:
    """The two permutations' tables, and what is read from them."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        k = bands * rows
        self.first = _permutation(101)
        second = _permutation(202)
        self.window = sliding_window_view(np.concatenate([second, second[: k - 1]]), k)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.first[(shingles & U(UNIVERSE - 1)).astype(np.int64)]
        out = self.window[at[:1024]].min(axis=0)
        for i in range(1024, len(at), 1024):
            np.minimum(out, self.window[at[i : i + 1024]].min(axis=0), out=out)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """(documents, bands) 64-bit keys; bands do not share keys."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows).astype(U)
        key = np.broadcast_to(scan.stream(303, self.bands), parts.shape[:2]).copy()
        for r in range(self.rows):
            key = scan.mix(key ^ (parts[:, :, r] * U(0x9E3779B97F4A7C15)))
        return key.view(np.int64)


def shingle_sets(texts: pa.LargeStringArray, width: int):
    """For each text, in order, its distinct shingles of ``width`` words as sorted 64-bit hashes."""
    for lo, hi, buf, off in scan.blocks(texts, BLOCK):
        starts, ends, at = scan.word_spans(buf, off, scan.NOT_SPACE)
        words = scan.word_hashes(buf, starts, ends)
        runs = words.copy()
        for k in range(1, width):
            if len(words) > k:
                runs[:-k] = scan.mix(runs[:-k] * U(0xD6E8FEB86659FD93) + words[k:])
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                whole = U(b - a)
                for w in words[a:b]:
                    whole = scan.mix(np.array([whole * U(0xA24BAED4963EE407) + w]))[0]
                yield np.array([whole])
            else:
                yield words[:0]


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, set_id, keys): set size, digest of the set, and band keys."""

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        s = scan.held(("sketcher", bands, rows), lambda: Sketcher(bands, rows))
        n, ids, keys = [], [], [np.zeros((0, bands), np.int64)]
        with np.errstate(over="ignore"):
            for u in shingle_sets(utf8(b.column(1)), width):
                n.append(len(u))
                ids.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) else None)
                if len(u):
                    keys.append(s.band_keys(s.signature(u)[None, :]))
        off = np.concatenate([[0], np.cumsum(np.where(np.array(n) > 0, bands, 0))])
        return [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(keys).reshape(-1)))]

    fields = [T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return extend(docs, fields, one, ["doc_id"])


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def one(b: pa.RecordBatch) -> list[pa.Array]:
        with np.errstate(over="ignore"):
            rows = list(shingle_sets(utf8(b.column(1)), width))
        off = np.cumsum([0] + [len(r) for r in rows])
        return [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate([np.zeros(0, U), *rows]).view(np.int64)))]

    return extend(docs, [T.StructField("shingles", T.ArrayType(T.LongType(), False))], one, ["doc_id"])


def _lists(sets: DataFrame, roots: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(token, sid, n, shared, rep, root, c): for each shingle, the c sets (sid, rep, shingles) that have it among their first; of several roots."""
    least = F.expr(f"({percent} * n + 99) div 100")
    words = sets.select("sid", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    # A table of its own, so that the join below is between two shuffles and a common shingle's side can be split.
    often = scratch.write(words.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"), "often")
    own = Window.partitionBy("sid")
    # Shingles that no other set has come first, so of the others the first (those shared) - need + 1 count.
    first = words.join(often, "token").select("sid", "token", "n", F.row_number().over(own.orderBy("often", "token")).alias("r"), F.count("*").over(own).alias("shared"))
    first = first.where(F.col("r") <= F.col("shared") - least + 1).select("sid", "token", "n", "shared")
    first = scratch.write(first.join(sets.select("sid", "rep").join(roots, "rep"), "sid"), "first")
    # Lists of the same sets are one list: they are told by two hashes over their sets.
    kinds = first.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "sid")).alias("y"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    kinds = scratch.write(kinds.where("lo < hi").groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token", "c"), "lists")
    return scratch.write(first.join(kinds, "token"), "members")


def _short(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of sets of different roots in lists of at most PIVOTS sets, each once, that can be linked by their sizes.

    What two sets have in common is within what each of them shares with any other.
    """
    one = lists.where(F.col("c") <= PIVOTS).select("token", "sid", "n", "shared", "root")
    pairs = one.toDF("token", "a", "na", "sa", "ra").join(one.toDF("token", "b", "nb", "sb", "rb"), "token").where("a < b and ra != rb")
    pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return pairs.where((100 + percent) * F.least("sa", "sb") >= percent * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def _long(lists: DataFrame, scratch: Scratch) -> DataFrame:
    """(token, sid, n, rep, root): the lists of more than PIVOTS sets, those of much the same sets as one.

    The lists of one cloud of texts have most of their sets in common, hence also
    mostly the set of least hash. All lists with the same such set are one, but
    for those to which that would add too many sets; so there are never more rows.
    """
    rows = scratch.write(lists.where(F.col("c") > PIVOTS).select("token", "c", "sid", "n", "rep", "root"), "long")
    heads = rows.groupBy("token", "c").agg(F.min(F.struct(F.xxhash64("sid", F.lit(8)), "sid")).alias("head"))
    heads = scratch.write(heads, "heads")
    whole = rows.join(heads.select("token", "head"), "token").select("head", "sid").distinct().groupBy("head").agg(F.count("*").alias("all"))
    alone = F.when(MERGED * F.col("c") < F.col("all"), F.col("token"))
    names = heads.join(whole, "head").select("token", F.min("token").over(Window.partitionBy("head", alone)).alias("name"))
    return rows.join(scratch.write(names, "names"), "token").select(F.col("name").alias("token"), "sid", "n", "rep", "root").distinct()


def _compared_in_groups(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v): the pairs (a, b) whose sets (sid, shingles) are linked.

    Pairs that hang together make a group, which is cut into blocks of bounded
    size; a task compares the pairs between two blocks, so a set is copied once
    for each block with which it has a pair, and never more often than it has pairs.
    """
    of = components(pairs.toDF("u", "v"), scratch).toDF("sid", "grp")
    nodes = of.join(sets.select("sid", F.size("shingles").cast("long").alias("n")), "sid")
    size = nodes.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    nodes = nodes.join(scratch.write(size, "blocks"), "grp").select("sid", "grp", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("blocks")).cast("int").alias("own"))
    nodes = scratch.write(nodes, "nodes")
    e = pairs.join(nodes.toDF("a", "grp", "x"), "a").join(nodes.select(F.col("sid").alias("b"), F.col("own").alias("y")), "b")
    e = scratch.write(e.select("grp", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b"), "compared")
    copies = scratch.write(e.select("grp", "i", "j", F.explode(F.array("a", "b")).alias("sid")).distinct(), "copies")
    rows = copies.join(sets.select("sid", "shingles"), "sid")

    def run(edges: pa.Table, held: pa.Table) -> pa.Table:
        column = held["shingles"].combine_chunks()
        off = column.offsets.to_numpy()
        flat, off = column.flatten().to_numpy(), off - off[0]
        at = {s: k for k, s in enumerate(held["sid"].to_pylist())}
        a, b = edges["a"].to_numpy(), edges["b"].to_numpy()
        order = np.argsort(a, kind="stable")
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1):
            if not len(part):
                continue
            x = at[int(a[part[0]])]
            s = np.sort(flat[off[x] : off[x + 1]])
            others = [at[int(y)] for y in b[part]]
            n = np.array([off[y + 1] - off[y] for y in others])
            tokens = np.concatenate([flat[off[y] : off[y + 1]] for y in others])
            hit = s[np.minimum(np.searchsorted(s, tokens), len(s) - 1)] == tokens
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
            out.append(part[100 * both >= percent * (len(s) + n - both)])
        chosen = np.concatenate([np.zeros(0, np.int64), *out])
        scan.release()
        return pa.table({"u": pa.array(a[chosen]), "v": pa.array(b[chosen])})

    return e.groupBy("grp", "i", "j").cogroup(rows.groupBy("grp", "i", "j")).applyInArrow(run, "u long, v long")


def _blocks(lists: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v): links between classes of different roots that share a list; at least one chain of links wherever there is a link.

    ``lists`` is (token, sid, n, rep, root, lo), lo the list's least root. A list is
    cut by hash into blocks of bounded size, first the sets of other roots, then
    those of lo, and each pair of its blocks, but for two of lo, is one task's group.
    """
    least = F.col("root") == F.col("lo")

    def blocks(which):
        return F.greatest(F.ceil(F.count_if(which) / BLOCK_ROWS), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")

    size = lists.groupBy("token").agg(blocks(F.lit(True)).alias("all"), blocks(~least).alias("k"), blocks(least).alias("m"))
    size = size.select("token", F.when(F.col("all") > 1, F.col("k")).otherwise(1).alias("k"), F.when(F.col("all") > 1, F.col("m")).otherwise(0).alias("m"))
    rows = lists.join(scratch.write(size, "blocks"), "token")
    apart, at = least & (F.col("m") > 0), F.xxhash64("sid", F.lit(3))
    rows = rows.withColumn("own", F.when(apart, F.col("k") + F.pmod(at, F.col("m"))).otherwise(F.pmod(at, F.col("k"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(apart, F.col("k")).otherwise(F.col("k") + F.col("m")) - 1)))
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "rep", "root")
    rows = scratch.write(rows, "pairs of blocks").join(sets.select("sid", "shingles"), "sid")

    def run(t: pa.Table) -> pa.Table:
        rep, root, own = (t[c].to_numpy() for c in ("rep", "root", "own"))
        column = t["shingles"].combine_chunks()
        off = column.offsets.to_numpy()
        flat, off = column.flatten().to_numpy(), off - off[0]
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        out = _compared(rep, root, flat, off, np.flatnonzero(own == i), np.flatnonzero(own == j), percent)
        return pa.table({"u": pa.array([p[0] for p in out], pa.int64()), "v": pa.array([p[1] for p in out], pa.int64())})

    return rows.groupBy("token", "i", "j").applyInArrow(run, "u long, v long")


def _compared(rep, root, flat, off, left, right, percent: int) -> list[tuple[int, int]]:
    """Links between the sets ``left`` and ``right`` (places in rep) that join roots; set k is flat[off[k] : off[k + 1]]."""
    n = np.diff(off)
    of = {r: r for r in root.tolist()}

    def find(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    # Of each shingle of the right side, the sets there that have it.
    inner = np.repeat(np.arange(len(right)), n[right])
    at = np.concatenate([np.arange(off[k], off[k + 1]) for k in right]) if len(right) else np.zeros(0, np.int64)
    order = np.argsort(flat[at], kind="stable")
    token, owner = flat[at][order], inner[order]
    labels = root.copy()  # of each set, its component so far
    out = []
    for x in left.tolist():
        other = labels[right] != labels[x]
        if not other.any():
            continue
        s = flat[off[x] : off[x + 1]]
        a, z = np.searchsorted(token, s, "left"), np.searchsorted(token, s, "right")
        c = z - a
        hits = owner[np.repeat(a - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        both = np.bincount(hits, minlength=len(right))
        for y in right[np.flatnonzero(other & (100 * both >= percent * (n[x] + n[right] - both)))].tolist():
            a, b = find(int(root[x])), find(int(root[y]))
            if a != b:
                of[max(a, b)] = min(a, b)
                labels[labels == max(a, b)] = min(a, b)
                out.append((int(rep[x]), int(rep[y])))
    return out


def near_duplicates(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (columns doc_id and text).

    Two documents are linked if 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id reachable by links.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", "text")
    sketch = scratch.write(sketches(docs, width, bands, rows), "sketch")
    classes = sketch.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    classes = scratch.write(classes, "classes")
    reps = sketch.select(F.col("doc_id").alias("rep"), "n", "set_id", "keys").join(classes, ["rep", "set_id"], "left_semi")
    spread = reps.select("rep", "n", F.explode("keys").alias("key"))
    # Written, so that the joins with it are between two shuffles, and a hot bucket's side can be split.
    shared = spread.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other")).where("pivot < other").select("key", "pivot")
    shared = scratch.write(shared, "shared")
    members = scratch.write(spread.join(shared, "key").select("key", "pivot", "rep"), "members")

    pairs = members.where("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = scratch.write(_confirm(docs, scratch.write(pairs, "pairs"), width, percent, scratch), "links")
    roots = scratch.write(components(links, scratch), "roots")
    # The classes of buckets that still hold more than one component.
    now = members.select("key", "rep").join(roots, members.rep == roots.node, "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    now = scratch.write(now, "now")
    several = scratch.write(now.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key"), "several")
    left = scratch.write(now.join(several, "key", "left_semi").select("rep", "root").distinct(), "left")
    sets = _sets(likely(docs, left.select("rep")), width).select(F.monotonically_increasing_id().alias("sid"), F.col("doc_id").alias("rep"), "shingles")
    sets = scratch.write(sets, "sets")
    lists = _lists(sets, left, percent, scratch)
    both = _compared_in_groups(scratch.write(_short(lists, percent), "pairs"), sets, percent, scratch)
    name = sets.select("sid", "rep")
    more = both.join(name.toDF("u", "ru"), "u").join(name.toDF("v", "rv"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    more = scratch.write(more, "links")
    lists = _long(lists, scratch)
    if more.limit(1).count():
        links = links.unionByName(more)
        roots = scratch.write(components(links, scratch), "roots")
        lists = lists.drop("root").join(roots, lists.rep == roots.node, "left").select("token", "sid", "n", "rep", F.coalesce("root", "rep").alias("root"))
    lists = scratch.write(lists, "rest")
    several = scratch.write(lists.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token", "lo"), "several")
    more = scratch.write(_blocks(scratch.write(lists.join(several, "token"), "lists"), sets, percent, scratch), "links")
    if more.limit(1).count():
        links = links.unionByName(more)
        roots = scratch.write(components(links, scratch), "roots")

    named = classes.join(roots, classes.rep == roots.node, "left").select("set_id", F.coalesce("root", "rep").alias("root"))
    # A doc_id of several rows with different texts joins their components.
    doc = sketch.select("doc_id", "n", "set_id").join(named, "set_id", "left")
    twice = doc.where("doc_id is not null").groupBy("doc_id").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("c > 1")
    more = twice.select(F.col("doc_id").alias("u"), F.col("lo").alias("v"))
    if more.limit(1).count():
        rows_of = doc.where("doc_id is not null and root is not null").join(twice.select("doc_id"), "doc_id", "left_semi")
        roots = scratch.write(components(links.unionByName(rows_of.select(F.col("doc_id").alias("u"), F.col("root").alias("v"))), scratch), "roots")
        doc = doc.join(roots, doc.root == roots.node, "left").select("doc_id", "n", "set_id", F.coalesce(roots.root, doc.root).alias("root"))
        doc = doc.join(roots.toDF("doc_id", "own"), "doc_id", "left").select("doc_id", "n", F.coalesce("root", "own").alias("root"))
    component = F.coalesce("root", "doc_id")
    return doc.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """(u, v) of the pairs (a, b) of class representatives that are linked, on their full sets."""
    need = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # A doc_id of several rows has several sets; a link of any is a link of the document.
    sets = scratch.write(_sets(likely(docs, scratch.write(need, "need")), width), "sets")
    return _linked(pairs, sets.withColumnRenamed("doc_id", "rep"), percent)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs (a, b) whose sets (rep, shingles) are linked."""
    size = F.size("shingles")
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"), size.alias("na"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"), size.alias("nb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(right, "b").join(left, "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return joined.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` on 2-word shingles at a Jaccard similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), width=2)
