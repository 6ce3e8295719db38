"""The memory bus: chunks in pipes, an embedding cache, search and retention.

All functions are DataFrame to DataFrame. Time is an argument (``as_of``, epoch
seconds); order is a column (``seq``).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors
from tessera.functions.chunking import OVERLAP, SIZE, effective_overlap, explode_chunks, windows_of, words
from tessera.operators.ordered import with_running
from tessera.runtime import ship

PIPE_CAP = 10_000
TOP_K = 5
#: Queries that go to the workers at once; more go in blocks.
QUERY_BLOCK = 4096


def in_pipe(chunks: DataFrame, pipe: str, source: str | None = None) -> DataFrame:
    """A pipe's chunks, of one source if asked for; an unknown pipe is empty."""
    out = chunks.where(F.col("pipe") == pipe)
    return out if source is None else out.where(F.col("source_app") == source)


def scored(chunks: DataFrame, query: Column, as_of: int | None = None, vector: str = "vector", ts: str = "ts_s") -> DataFrame:
    """``chunks`` with score: dot product with the query, weighted by age if ``as_of`` is given. NaN scores go."""
    score = vectors.dot(F.col(vector), query)
    if as_of is not None:
        score = score * vectors.decay(F.lit(as_of) - F.col(ts))
    return chunks.withColumn("score", score).where(F.col("score").isNotNull() & ~F.isnan("score"))


def top_k(scores: DataFrame, k: int = TOP_K, tie: str = "seq") -> DataFrame:
    """The k best rows, ties by ``tie``; none for k = 0."""
    return scores.orderBy(F.desc("score"), F.asc(tie)).limit(k)


def search(chunks: DataFrame, query: list[float] | Column, pipe: str, k: int = TOP_K, filter_app: str | None = None, as_of: int | None = None) -> DataFrame:
    """(text, score, source_app, timestamp) of the k chunks of a pipe nearest to the query."""
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    best = top_k(scored(in_pipe(chunks, pipe, filter_app), q, as_of), k)
    return best.select("text", "score", "source_app", F.col("ts_s").alias("timestamp"))


def search_batch(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, as_of: int | None = None, tie: str = "seq", join_on: list[str] | None = None) -> DataFrame:
    """For each row of ``queries`` (query_id, query_vector) its k best chunks, with rank.

    The queries are a stated set held against all chunks. They go to the workers
    in blocks of QUERY_BLOCK rows, chosen by hash. A worker scores a batch of
    chunks at once and passes on the k best for each query; the scores are those
    of ``scored``, bit by bit, as sums run in the same order. With ``join_on``
    a query only meets the chunks that agree in these columns, in a join.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for i in range(blocks):
        q = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        if join_on:
            found = scored(chunks.join(F.broadcast(q), join_on), F.col("query_vector"), as_of)
        else:
            found = _best(chunks, q, k, as_of, tie)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(tie))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("query_vector")
        out = found if out is None else out.unionByName(found)
    return out


def _best(chunks: DataFrame, queries: DataFrame, k: int, as_of: int | None, tie: str) -> DataFrame:
    """``scored`` of all pairs of chunks and queries, but of each query only the k best of every batch of chunks."""
    spark = chunks.sparkSession
    ship(spark)
    rows = queries.where("query_vector is not null").toArrow()
    rest = [f for f in queries.schema.fields if f.name != "query_vector"]
    asked = rows.select([f.name for f in rest]).append_column("_query", pa.array(range(len(rows)), pa.int32()))
    asked = spark.createDataFrame(asked, T.StructType([*rest, T.StructField("_query", T.IntegerType())]))
    shared = spark.sparkContext.broadcast(vectors.matrices(rows["query_vector"]))
    columns = chunks.columns
    weight = F.lit(None).cast("double") if as_of is None else vectors.decay(F.lit(as_of) - F.col("ts_s"))
    chunks = chunks.where("vector is not null").withColumn("_weight", weight)
    fields = [*chunks.schema.fields[:-1], T.StructField("_query", T.IntegerType()), T.StructField("score", T.DoubleType())]

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            w = None if as_of is None else b.column(b.schema.get_field_index("_weight")).to_numpy()
            place = pc.rank(t[tie], null_placement="at_start", tiebreaker="dense").to_numpy()
            for query, row, score in vectors.best(t["vector"], shared.value, k, w, place):
                got = t.select(columns).take(pa.array(row)).combine_chunks()
                got = got.append_column("_query", pa.array(query, pa.int32())).append_column("score", pa.array(score))
                yield from got.to_batches()

    found = chunks.mapInArrow(run, T.StructType(fields)).join(F.broadcast(asked), "_query")
    return found.select(*columns, *(f.name for f in rest), "score")


def share_chunks(requests: DataFrame) -> DataFrame:
    """Requests with defaults filled in, a row for each chunk, with pos; blank texts give none.

    Columns: request_id, source_app, target_pipe, knowledge_text, chunk_size,
    chunk_overlap, chunk_strategy, the last three may be null.
    """
    size = F.coalesce("chunk_size", F.lit(SIZE))
    over = effective_overlap(size, F.coalesce("chunk_overlap", F.lit(OVERLAP)))
    exact = F.coalesce("chunk_strategy", F.lit("")) == "exact_match"
    split = requests.withColumn("_words", words(F.col("knowledge_text")))
    cut = F.when(exact, F.array("knowledge_text")).otherwise(windows_of(F.col("_words"), size, over))
    return split.select("request_id", "source_app", F.col("target_pipe").alias("pipe"), F.posexplode(cut).alias("pos", "text"))


def probe(chunks: DataFrame, cache: DataFrame, model: str, as_of: int, ttl_s: int) -> DataFrame:
    """``chunks`` with is_hit and the cached vector.

    A chunk is a hit if its text is in the cache, or if an earlier request of the
    batch has it: requests run in order of request_id, each is probed before it
    is written, and what it writes is in the cache for those after it. Then
    ``cached`` is null, and the vector is the one embedded for that request.
    """
    live = cache.where((F.col("model") == model) & fresh(F.col("ts_s"), as_of, ttl_s)).select(F.col("text_key").alias("text"), F.col("vector").alias("cached"))
    first = chunks.groupBy("text").agg(F.min("request_id").alias("_first")).join(live, "text", "left")
    out = chunks.join(first, "text").withColumn("is_hit", F.col("cached").isNotNull() | (F.col("request_id") > F.col("_first")))
    return out.drop("_first")


def fresh(ts: Column, as_of: int, ttl_s: int) -> Column:
    """Whether a row is younger than the time to live; 0 means for ever, and no age is below 0."""
    return F.lit(ttl_s == 0) | (F.greatest(F.lit(as_of) - ts, F.lit(0)) < ttl_s)


def write_order(probed: DataFrame, begin: int = 0) -> DataFrame:
    """seq of new chunks: of each request, in order of request, first the misses and then the hits, by position."""
    size = probed.groupBy("request_id").agg(F.count("*").alias("n"))
    upto = with_running(size, ["request_id"], {"upto": ("sum", F.col("n"))})
    first = upto.select("request_id", (F.col("upto") - F.col("n")).alias("first"))
    order = Window.partitionBy("request_id").orderBy("is_hit", "pos")
    out = probed.withColumn("rn", F.row_number().over(order)).join(first, "request_id")
    return out.withColumn("seq", F.col("first") + F.col("rn") + (begin - 1)).drop("first", "rn")


def unit(vector: Column) -> Column:
    """A vector as it is stored: of unit length, or zero."""
    return vectors.l2_normalize(vector).cast("array<float>")


def write_chunks(chunks: DataFrame, cache: DataFrame, new: DataFrame, model: str, as_of: int, cap: int = PIPE_CAP) -> tuple[DataFrame, DataFrame]:
    """Chunks and cache after new vectors (pipe, seq, text, vector, source_app) are written to both, of unit length. Duplicates stay in a pipe; of a text the last is cached."""
    rows = new.select("pipe", "seq", "text", unit(F.col("vector")).alias("vector"), "source_app", F.lit(as_of).cast("long").alias("ts_s"))
    last = rows.groupBy("text").agg(F.max_by("vector", "seq").alias("vector"), F.max("seq").alias("seq"))
    entries = last.select(F.lit(model).alias("model"), F.col("text").alias("text_key"), "vector", F.lit(as_of).cast("long").alias("ts_s"), "seq")
    return append(chunks, rows, cap), upsert(cache, entries)


def write_cached(chunks: DataFrame, hits: DataFrame, as_of: int, cap: int = PIPE_CAP) -> DataFrame:
    """The pipes with hits (pipe, seq, text, cached, source_app): vectors as they are in the cache, which stays untouched, and the time of writing."""
    rows = hits.select("pipe", "seq", "text", F.col("cached").alias("vector"), "source_app", F.lit(as_of).cast("long").alias("ts_s"))
    return append(chunks, rows, cap)


def cache_only(cache: DataFrame, texts: DataFrame, model: str, as_of: int) -> DataFrame:
    """The cache with vectors (seq, text, vector) that go to no pipe; of unit length, so that a later hit may go to one."""
    rows = texts.select(F.lit(model).alias("model"), F.col("text").alias("text_key"), unit(F.col("vector")).alias("vector"), F.lit(as_of).cast("long").alias("ts_s"), "seq")
    return upsert(cache, rows)


def append(chunks: DataFrame, new: DataFrame, cap: int = PIPE_CAP) -> DataFrame:
    """The pipes with new chunks, each pipe cut to its newest ``cap``. Duplicates stay."""
    return ring(chunks.unionByName(new), cap)


def ring(chunks: DataFrame, cap: int = PIPE_CAP) -> DataFrame:
    """The newest ``cap`` chunks of each pipe, by seq; a limit in every partition comes before the shuffle."""
    newest = Window.partitionBy("pipe").orderBy(F.desc("seq"))
    return chunks.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= cap).drop("_age")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after writes: the last by seq of each model and text wins. Both have seq."""
    every = cache.unionByName(new)
    return every.groupBy("model", "text_key").agg(F.max_by(F.struct("vector", "ts_s", "seq"), F.struct("ts_s", "seq")).alias("w")).select("model", "text_key", "w.vector", "w.ts_s", "w.seq")


def zip_vectors(texts: Column, vectors_: Column) -> Column:
    """Texts and vectors by position, as long as the shorter."""
    n = F.least(F.size(texts), F.size(vectors_))
    return F.slice(F.arrays_zip(texts.alias("text"), vectors_.alias("vector")), F.lit(1), n)


def sweep(rows: DataFrame, as_of: int, ttl_s: int, ts: str = "ts_s") -> DataFrame:
    """The rows that a collection at ``as_of`` keeps; search shows expired rows until one runs."""
    return rows.where(fresh(F.col(ts), as_of, ttl_s))


def sweep_counters(cache: DataFrame, chunks: DataFrame, as_of: int, cache_ttl_s: int, pipe_ttl_s: int) -> DataFrame:
    """One row: cache rows, chunks and pipes that a collection removes from."""
    gone = ~fresh(F.col("ts_s"), as_of, pipe_ttl_s)
    a = cache.agg(F.count_if(~fresh(F.col("ts_s"), as_of, cache_ttl_s)).alias("cache_removed"))
    b = chunks.where(gone).groupBy("pipe").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks_removed"), F.count("*").alias("pipes_touched"))
    return a.crossJoin(b)


def split_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return explode_chunks(docs, "text", size, overlap)
