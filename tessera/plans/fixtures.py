"""Small fixed inputs of the catalog and model queries, as Spark rows and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.schemas import MANIFEST
from tessera.sources.files import SECTIONS


def _manifest(app_id: str, **sections) -> dict:
    out = {"app_id": app_id, "description": "", "version": "1.0.0"}
    for name, default in SECTIONS.items():
        out[name] = dict(default) | sections.get(name, {})
    return out


def _usual(app_id: str, models=("qwen2.5:0.5b",), priority="normal", pipes=(), agents=(), network=False, pii=True, **more) -> dict:
    resources = {"allowed_models": list(models), "max_tokens_per_minute": 10_000, "gpu_priority": priority} | more.pop("resources", {})
    return _manifest(
        app_id,
        privacy={"enforce_pii_redaction": pii},
        resources=resources,
        network={"network_enabled": network},
        ipc={"allowed_agent_targets": list(agents), "allowed_semantic_pipes": list(pipes)},
        **more,
    )


BOTH = ("qwen2.5:0.5b", "llama3.2:1b")
MANIFESTS = [
    _usual("agent_alpha", agents=["agent_beta"]),
    _usual("agent_beta", agents=["agent_alpha"]),
    _usual("cyber_agent", ["gemma3"], "high", pii=False),
    _usual("cyber_spider", ["deepseekR1:8b"]),
    _usual("paged_agent", network=True, resources={"stateful_paging": True}),
    _usual("pipeline_analyst", BOTH, pipes=["pipeline_data", "pipeline_analysis"]),
    _usual("pipeline_reporter", BOTH, pipes=["pipeline_analysis"]),
    _usual("pipeline_researcher", BOTH, pipes=["pipeline_data"]),
    _usual("scraper_agent", BOTH, pipes=["research"]),
    _usual("swarm_writer", BOTH, pipes=["research"]),
    _usual("terminal_user", ["llama3.2:1b"], network=True, agents=["writer_agent"], pipes=["rust_docs"]),
    _usual("web_scrapper", ["mistral-3-3b"], network=True),
    _usual("web_toolkit", priority="low", pii=False),
    _usual("writer_agent", ["llama3.2:1b"], agents=["terminal_user"], pipes=["rust_docs"]),
    _manifest("no_resources"),
    _usual("short_history", memory_limits={"max_chat_history_messages": 1}),
    _usual("dormant", [], "  "),
    _usual("shell", execution={"can_execute_shell": True, "can_execute_wasm": True}),
    _usual("wasm", execution={"can_execute_wasm": True}, file_system={"allowed_read_paths": ["/in"]}),
    _usual("writer", file_system={"allowed_write_paths": ["/out"]}),
    _usual("both_paths", file_system={"allowed_read_paths": ["/in"], "allowed_write_paths": ["/out"]}, resources={"json_history": True, "stateful_paging": True}),
]


def manifests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANIFESTS, MANIFEST)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]::VARCHAR[]"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values_sql(rows: list[tuple], name: str, columns: list[str]) -> str:
    body = ",\n".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


_FLAT = [(s, k) for s in SECTIONS for k in SECTIONS[s]]
#: The manifests as a common table expression; columns are named section_field without the section where that is clear.
MANIFESTS_SQL = values_sql([(m["app_id"], m["version"], *(m[s][k] for s, k in _FLAT)) for m in MANIFESTS], "m", ["app_id", "version", *(k for _, k in _FLAT)])

CHECKS = [(1, "agent_alpha", "agent_beta"), (2, "agent_alpha", "writer_agent"), (3, "nobody", "agent_beta"), (4, "writer_agent", "terminal_user"), (5, "scraper_agent", "research"), (6, "scraper_agent", "rust_docs"), (7, "terminal_user", "rust_docs"), (8, "paged_agent", "research")]
NAMES = [
    (1, "qwen2.5:0.5b", "qwen2"), (2, "llama3.2:1b", "llama"), (3, "Llama-3.3-70B", "llama"), (4, "llama3.1:8b", "llama"),
    (5, "llama-4-scout", "llama"), (6, "Llama-2-7b", "llama"), (7, "codellama:7b", "llama"), (8, "mistral", "llama"),
    (9, "qwen2.5:0.5b-base", "qwen2"), (10, "llama2-base", "llama"), (11, "all-minilm", "bert"), (12, "other", "nomic"),
]
LISTS = [(1, "a, b ,c"), (2, "  "), (3, "one"), (4, ""), (5, "x,,y")]
TOKENS = [(1, [5, 6, 128009, 7]), (2, [128001]), (3, [1, 2, 3]), (4, []), (5, [9, 77, 128001])]
CONFIGS = [(1, '{"architectures":["NomicBertModel"]}'), (2, '{"architectures":["BertModel","X"]}'), (3, "{}"), (4, '{"architectures":["T5"]}')]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
