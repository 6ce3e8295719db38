"""The library's calls in one place: sharing, searching, messages, admission and histories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import firewall
from tessera.operators import admission, catalog, embed, memory, messages, schedule
from tessera.schemas import CACHE, CHUNKS
from tessera.sources import files


@dataclass
class State:
    """What a call reads and gives back: tables, never hidden state. ``cache`` has seq for upserts."""

    chunks: DataFrame
    cache: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(spark.createDataFrame([], CHUNKS), spark.createDataFrame([], CACHE).withColumn("seq", F.lit(0).cast("long")))


def share(requests: DataFrame, manifests: DataFrame, state: State, driver: embed.Driver, as_of: int, ttl_s: int = 0, cap: int = memory.PIPE_CAP, begin: int = 0) -> State:
    """Chunks of the allowed requests, embedded once for each text that is not cached, added to their pipes.

    Misses are embedded, brought to unit length, and cached; hits, also those of
    an earlier request of the batch, take the vector that is cached. ``begin`` is
    the first free seq.
    """
    allowed = catalog.allowed(requests, catalog.registry(manifests), "pipe", "source_app", "target_pipe")
    probed = memory.write_order(memory.probe(memory.share_chunks(allowed), state.cache, driver.name, as_of, ttl_s), begin)
    fresh = embed.embed(probed.where("not is_hit"), driver, "text", "vector")
    rows = probed.join(fresh.withColumn("vector", memory.unit(F.col("vector"))), "text", "left").withColumn("cached", F.coalesce("cached", "vector"))
    _, cache = memory.write_chunks(state.chunks, state.cache, rows.where("not is_hit"), driver.name, as_of, cap)
    return State(memory.write_cached(state.chunks, rows, as_of, cap), cache)


def cache_only(texts: DataFrame, state: State, driver: embed.Driver, as_of: int) -> State:
    """Vectors of texts (seq, text) that are cached and put in no pipe."""
    return State(state.chunks, memory.cache_only(state.cache, embed.with_vectors(texts, driver), driver.name, as_of))


def search(state: State, driver: embed.Driver, query: str, pipe: str, k: int = memory.TOP_K, filter_app: str | None = None, as_of: int | None = None) -> DataFrame:
    """(text, score, source_app, timestamp) of the k chunks of a pipe nearest to a text."""
    return memory.search(state.chunks, [float(x) for x in driver.embed([query])[0]], pipe, k, filter_app, as_of)


def sweep(state: State, as_of: int, cache_ttl_s: int, pipe_ttl_s: int) -> State:
    """A collection: what is not expired. Until one runs, search shows expired chunks."""
    return State(memory.sweep(state.chunks, as_of, pipe_ttl_s), memory.sweep(state.cache, as_of, cache_ttl_s))


def secure(prompts: DataFrame, text: str = "prompt") -> DataFrame:
    """``prompts`` with blocked, reason and safe_prompt; the tag of each row is made once."""
    tagged = prompts.withColumn("_tag", firewall.random_tag())
    return tagged.withColumn("blocked", firewall.is_injection(F.col(text))).withColumn("reason", firewall.reason(F.col(text))).withColumn("safe_prompt", firewall.secured(F.col(text), F.col("_tag"))).drop("_tag")


deliver, poll = messages.deliver, messages.poll
admit = admission.admit
lease, switches = schedule.queue, schedule.switches
agents_view, manifests_view = catalog.agents_view, catalog.manifests_view
share_requests, search_requests = files.share_requests, files.search_requests
stream_tokens = messages.stream_tokens
read_manifests, read_config, local_models = files.read_manifests, files.read_config, files.local_models
page_in, page_out, clear_history = files.page_in, files.page_out, files.clear_page
