"""Files: manifests and configuration (TOML), histories (JSON), model folders."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import HISTORY, MANIFEST, RUN_REQUEST, SEARCH_REQUEST, SEND_REQUEST, SHARE_REQUEST, TURN

#: Keys without which a request is an error, and the strategies that a share request may name.
MANDATORY = {"source_app", "target_pipe", "knowledge_text", "query", "from_app", "to_app", "payload", "model", "prompt"}
STRATEGIES = ("sliding_window", "sentence_aware", "paragraph", "exact_match")

# What a missing section stands for; fields without a default here must be in a section that is present.
SECTIONS = {
    "privacy": {"enforce_pii_redaction": False},
    "resources": {"allowed_models": [], "max_tokens_per_minute": 0, "gpu_priority": "", "json_history": False, "stateful_paging": False},
    "memory_limits": {"max_chat_history_messages": 20, "auto_summarize_on_cap": True},
    "file_system": {"allowed_read_paths": [], "allowed_write_paths": [], "max_file_size_mb": 0},
    "network": {"network_enabled": False, "allowed_domains": [], "allow_localhost_access": False},
    "execution": {"can_execute_shell": False, "can_execute_wasm": False, "allowed_tools": []},
    "ipc": {"allowed_agent_targets": [], "allowed_semantic_pipes": []},
}
OPTIONAL = {"resources": {"json_history", "stateful_paging"}, "ipc": {"allowed_agent_targets", "allowed_semantic_pipes"}}


class ManifestError(ValueError):
    """A manifest that cannot be parsed; it ends the whole load."""


def parse_manifest(text: str, name: str = "manifest") -> dict:
    """A manifest as a record; unknown keys are ignored, missing sections take their defaults."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ManifestError(f"{name}: {e}") from e
    out = {}
    for key in ("app_id", "description", "version"):
        if not isinstance(raw.get(key), str):
            raise ManifestError(f"{name}: {key} is missing")
        out[key] = raw[key]
    for section, default in SECTIONS.items():
        given = raw.get(section)
        if given is None:
            out[section] = dict(default)
            continue
        out[section] = {}
        for key, value in default.items():
            if key not in given and key not in OPTIONAL.get(section, ()):
                raise ManifestError(f"{name}: {section}.{key} is missing")
            got = given.get(key, value)
            if not isinstance(got, type(value)) or isinstance(value, int) and not isinstance(value, bool) and (isinstance(got, bool) or got < 0):
                raise ManifestError(f"{name}: {section}.{key} has the wrong type")
            out[section][key] = got
    return out


def to_toml(manifest: dict) -> str:
    """A manifest's text, sections in order."""

    def value(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        return str(v) if isinstance(v, int) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'

    lines = [f"{k} = {value(manifest[k])}" for k in ("app_id", "description", "version")]
    for section in SECTIONS:
        lines += ["", f"[{section}]"] + [f"{k} = {value(v)}" for k, v in manifest[section].items()]
    return "\n".join(lines) + "\n"


def read_manifests(spark: SparkSession, folder: str, most: int = 100_000) -> DataFrame:
    """Every ``*.toml`` of a folder; of one app_id the last file by name wins. A missing folder is made and empty.

    Manifests are a small catalog: their number is checked before they are parsed.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        fs.mkdirs(path)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/*.toml"))
    if not len(found):
        return spark.createDataFrame([], MANIFEST)
    if len(found) > most:
        raise ValueError(f"{len(found)} manifests; the catalog is sized for {most}")
    files = spark.read.format("binaryFile").load(folder.rstrip("/") + "/*.toml").select("path", F.decode("content", "UTF-8").alias("text"))
    by_app = {}
    for r in files.orderBy("path").collect():
        m = parse_manifest(r.text, r.path)
        by_app[m["app_id"]] = m
    return spark.createDataFrame(list(by_app.values()), MANIFEST)


@dataclass
class Config:
    engine: str
    embedder: str
    cache_ttl_hours: int
    pipe_ttl_hours: int
    extra: dict = field(default_factory=dict)


def read_config(spark: SparkSession, path: str) -> Config:
    """Engine, embedder and times to live; the memory section is mandatory, a missing file is an error."""
    text = spark.read.text(path, wholetext=True).first()
    raw = tomllib.loads(text.value if text else "")
    if "memory" not in raw or "system" not in raw:
        raise ValueError("the sections system and memory are mandatory")
    return Config(raw["system"]["engine"], raw["system"].get("embedder", "all-minilm"), raw["memory"]["cache_ttl_hours"], raw["memory"]["pipe_ttl_hours"])


def page_out(history: DataFrame, folder: str) -> None:
    """Writes each application's whole history as one file of its folder, replacing what it had and no other's.

    Every page begins with a line of turn -1 that is no turn, so that an empty
    history, too, takes the place of an old page.
    """
    head = F.array(F.struct(F.lit(-1).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content")))
    body = F.transform(F.coalesce("history", F.array().cast(HISTORY["history"].dataType)), lambda t, i: F.struct(i.alias("turn"), t["role"].alias("role"), t["content"].alias("content")))
    turns = history.select("app_id", F.inline(F.concat(head, body))).repartition("app_id")
    turns.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("app_id").json(folder)


def page_in(spark: SparkSession, apps: DataFrame, folder: str) -> DataFrame:
    """(app_id, history) for each of ``apps``; a missing or unreadable history is empty."""
    none = F.array().cast(HISTORY["history"].dataType)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(conf).exists(path):
        return apps.select("app_id", none.alias("history"))
    turns = spark.read.schema("turn int, role string, content string, app_id string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    # A corrupt line makes the whole page unreadable.
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    good = turns.groupBy("app_id").agg(listed.alias("l"), F.count("_bad").alias("bad")).where("bad = 0")
    good = good.select("app_id", F.transform(F.filter("l", lambda t: t["turn"] >= 0), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("history"))
    return apps.join(good, "app_id", "left").select("app_id", F.coalesce("history", none).alias("history"))


def read_page(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of turns in one file, as a history; an unreadable one is empty."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", f"array<{TURN.simpleString()}>")
    return text.select(F.coalesce(parsed, F.array().cast(f"array<{TURN.simpleString()}>")).alias("history"))


def clear_page(spark: SparkSession, folder: str, app_id: str) -> None:
    """Removes an application's history; nothing happens where there is none."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/app_id={app_id}")
    path.getFileSystem(conf).delete(path, True)


def _requests(spark: SparkSession, lines: DataFrame, schema) -> DataFrame:
    """JSON lines (column value) as rows of a fixed schema; unknown keys are ignored, a line that is no object, or lacks a key that must be there, is an error when it is read."""
    parsed = lines.select("value", F.from_json("value", schema).alias("r"))
    must = [f.name for f in schema if f.name in MANDATORY]
    given = F.col("r").isNotNull()
    for name in must:
        given = given & F.col(f"r.{name}").isNotNull()
    checked = F.when(given, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not a request: "), F.substring(F.coalesce("value", F.lit("null")), 1, 80))))
    return parsed.select(checked.alias("r")).select("r.*")


def share_requests(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Share requests from JSON lines; an unknown strategy is an error."""
    rows = _requests(spark, lines, SHARE_REQUEST)
    known = F.col("chunk_strategy").isNull() | F.col("chunk_strategy").isin(*STRATEGIES)
    return rows.withColumn("chunk_strategy", F.when(known, F.col("chunk_strategy")).otherwise(F.raise_error(F.concat(F.lit("unknown chunk_strategy: "), F.col("chunk_strategy")))))


def search_requests(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Search requests from JSON lines."""
    return _requests(spark, lines, SEARCH_REQUEST)


def send_requests(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Messages from JSON lines."""
    return _requests(spark, lines, SEND_REQUEST)


def run_requests(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Prompts for a model from JSON lines."""
    return _requests(spark, lines, RUN_REQUEST)


def local_models(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size_bytes, modified_at) for each subfolder; 0 and UNKNOWN without a model.gguf. Only file status is read."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    fs = Path(folder).getFileSystem(conf)
    rows = []
    for s in fs.listStatus(Path(folder)) if fs.exists(Path(folder)) else []:
        if s.isDirectory():
            model = Path(s.getPath(), "model.gguf")
            st = fs.getFileStatus(model) if fs.exists(model) else None
            rows.append((s.getPath().getName(), st.getLen() if st else 0, st.getModificationTime() if st else None))
    df = spark.createDataFrame(rows, "folder string, size_bytes long, ms long")
    when = F.date_format(F.timestamp_millis("ms"), "dd-MM-yyyy HH:mm:ss")
    return df.select(F.replace("folder", F.lit("-"), F.lit(":")).alias("name"), "size_bytes", F.coalesce(when, F.lit("UNKNOWN")).alias("modified_at"))
