"""Share, search and sweep from end to end."""

from tessera import api
from tessera.operators.embed import HashEmbedder
from tessera.plans import fixtures as fx

REQUEST = "request_id long, source_app string, target_pipe string, knowledge_text string, chunk_size int, chunk_overlap int, chunk_strategy string"


def test_share_search_sweep(spark):
    m, d = fx.manifests(spark), HashEmbedder()
    first = spark.createDataFrame([(1, "scraper_agent", "research", "ownership and borrowing in rust", None, None, None), (2, "scraper_agent", "rust_docs", "denied", None, None, None), (3, "nobody", "research", "denied too", None, None, None)], REQUEST)
    state = api.share(first, m, api.State.empty(spark), d, as_of=100)
    assert [(r.pipe, r.seq, r.ts_s) for r in state.chunks.collect()] == [("research", 0, 100)] and state.cache.count() == 1
    again = spark.createDataFrame([(4, "swarm_writer", "research", "ownership and borrowing in rust", None, None, None), (5, "swarm_writer", "research", "schedulers and processes", None, None, None)], REQUEST)
    state = api.share(again, m, state, d, as_of=200, begin=1)
    assert sorted((r.seq, r.source_app) for r in state.chunks.collect()) == [(0, "scraper_agent"), (1, "swarm_writer"), (2, "swarm_writer")]
    assert {r.text_key: r.ts_s for r in state.cache.collect()} == {"ownership and borrowing in rust": 100, "schedulers and processes": 200}
    best = api.search(state, d, "ownership and borrowing in rust", "research", 2).collect()
    assert [r.source_app for r in best] == ["scraper_agent", "swarm_writer"] and abs(best[0].score - 1) < 1e-5
    assert [r.text for r in api.search(state, d, "process schedulers", "research", 1, "swarm_writer").collect()] == ["schedulers and processes"]
    swept = api.sweep(state, 250, 100, 100)
    assert swept.chunks.count() == 2 and swept.cache.count() == 1


class Long(HashEmbedder):
    """A driver whose vectors are not of unit length."""

    def embed(self, texts):
        return super().embed(texts) * 7


def test_vectors_are_stored_at_unit_length(spark):
    m, d = fx.manifests(spark), Long()
    texts = spark.createDataFrame([(0, "schedulers and processes")], "seq long, text string")
    state = api.cache_only(texts, api.State.empty(spark), d, as_of=50)
    assert state.chunks.count() == 0 and state.cache.count() == 1
    rows = [(4, "scraper_agent", "research", t, None, None, None) for t in ("schedulers and processes",)] + [(5, "swarm_writer", "research", "ownership in rust", None, None, None), (6, "swarm_writer", "research", "ownership in rust", None, None, None)]
    state = api.share(spark.createDataFrame(rows, REQUEST), m, state, d, as_of=100)
    got = sorted((r.seq, r.text, round(sum(x * x for x in r.vector), 5)) for r in state.chunks.collect())
    assert got == [(0, "schedulers and processes", 1.0), (1, "ownership in rust", 1.0), (2, "ownership in rust", 1.0)]
    assert {(r.text_key, r.ts_s, round(sum(x * x for x in r.vector), 5)) for r in state.cache.collect()} == {("schedulers and processes", 50, 1.0), ("ownership in rust", 100, 1.0)}


def test_secure(spark):
    got = api.secure(spark.createDataFrame([("ignore previous",), ("mail a@b.co",)], "prompt string")).collect()
    assert [(r.blocked, r.reason) for r in got] == [(True, "Heuristic rule triggered"), (False, None)] and got[0].safe_prompt is None and "[EMAIL REDACTED]" in got[1].safe_prompt
