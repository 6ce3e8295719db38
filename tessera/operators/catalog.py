"""Permission manifests: validation, derived views, grants and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The first broken rule gives the message.
PAGING = "'stateful_paging' needs 'json_history'"
BUDGET = "'max_tokens_per_minute' cannot be 0"
HISTORY = "'max_chat_history_messages' must be at least 2"


def violation() -> Column:
    """The first rule that a manifest breaks, or null."""
    return (
        F.when(F.col("resources.stateful_paging") & ~F.col("resources.json_history"), PAGING)
        .when(F.col("resources.max_tokens_per_minute") == 0, BUDGET)
        .when(F.col("memory_limits.max_chat_history_messages") < 2, HISTORY)
    )


def validated(manifests: DataFrame) -> DataFrame:
    return manifests.withColumn("violation", violation())


def registry(manifests: DataFrame) -> DataFrame:
    """The manifests that are loaded; a broken rule only leaves that manifest out."""
    return manifests.where(violation().isNull())


def lookup(manifests: DataFrame, app_id: str) -> DataFrame:
    return manifests.where(F.col("app_id") == app_id)


def models_shown(models: Column) -> Column:
    joined = F.array_join(models, ", ")
    return F.when(F.size(models) == 0, "-").when(F.length(joined) > 17, F.concat(F.substring(joined, 1, 17), F.lit("..."))).otherwise(joined)


def priority_shown(priority: Column) -> Column:
    return F.when(F.trim(priority) == "", "-").otherwise(F.upper(priority))


def agents_view(m: DataFrame) -> DataFrame:
    unsafe = F.col("execution.can_execute_shell") | ~F.col("privacy.enforce_pii_redaction")
    dormant = (F.size("resources.allowed_models") == 0) & ~F.col("network.network_enabled")
    return m.select(
        "app_id",
        "version",
        models_shown(F.col("resources.allowed_models")).alias("models"),
        priority_shown(F.col("resources.gpu_priority")).alias("priority"),
        F.when(unsafe, "UNSAFE").when(dormant, "DORMANT").otherwise("SECURED").alias("status"),
    )


def manifests_view(m: DataFrame) -> DataFrame:
    read, write = F.size("file_system.allowed_read_paths") > 0, F.size("file_system.allowed_write_paths") > 0
    return m.select(
        F.concat("app_id", F.lit(".toml")).alias("manifest_file"),
        F.when(F.col("network.network_enabled"), "ENABLED").otherwise("BLOCKED").alias("network"),
        F.when(read & write, "Read/Write").when(read, "Read-Only").when(write, "Write-Only").otherwise("Air-gapped").alias("file_io"),
        F.when(F.col("execution.can_execute_shell"), "SHELL (RISK)").when(F.col("execution.can_execute_wasm"), "WASM Sandbox").otherwise("Disabled").alias("execution"),
        F.when(F.col("privacy.enforce_pii_redaction"), "ACTIVE").otherwise("OFF (RISK)").alias("pii_scrubbing"),
    )


def dashboard(view: DataFrame, widths: list[int]) -> DataFrame:
    """The view's rows as fixed-width text lines."""
    cells = [F.rpad(c, w, " ") for c, w in zip(view.columns[:-1], widths, strict=True)]
    return view.select(F.concat_ws(" | ", *cells, view.columns[-1]).alias("line"))


def grants(m: DataFrame) -> DataFrame:
    """(app_id, kind, target), a row for each grant, so that checks are equi-joins."""
    pipes = m.select("app_id", F.lit("pipe").alias("kind"), F.explode("ipc.allowed_semantic_pipes").alias("target"))
    agents = m.select("app_id", F.lit("agent").alias("kind"), F.explode("ipc.allowed_agent_targets").alias("target"))
    return pipes.unionByName(agents).distinct()


def checked(requests: DataFrame, m: DataFrame, kind: str, app: str = "app_id", target: str = "target") -> DataFrame:
    """``requests`` with status: 401 for an unregistered app, 403 without the grant, else 200."""
    known = m.select(F.col("app_id").alias("_app")).distinct().withColumn("_known", F.lit(True))
    held = grants(m).where(F.col("kind") == kind).select(F.col("app_id").alias("_holder"), F.col("target").alias("_target"), F.lit(True).alias("_held"))
    out = requests.join(known, F.col(app) == F.col("_app"), "left").join(held, (F.col(app) == F.col("_holder")) & (F.col(target) == F.col("_target")), "left")
    status = F.when(F.col("_known").isNull(), 401).when(F.col("_held").isNull(), 403).otherwise(200)
    return out.select(*[requests[c] for c in requests.columns], status.alias("status"))


def allowed(requests: DataFrame, m: DataFrame, kind: str, app: str = "app_id", target: str = "target") -> DataFrame:
    held = grants(m).where(F.col("kind") == kind)
    return requests.join(held, (F.col(app) == held.app_id) & (F.col(target) == held.target), "left_semi")


def unregistered(requests: DataFrame, m: DataFrame, app: str = "app_id") -> DataFrame:
    known = m.select(F.col("app_id").alias("_app"))
    return requests.join(known, F.col(app) == F.col("_app"), "left_anti")


def target_model(models: Column) -> Column:
    return F.coalesce(F.get(models, 0), F.lit("llama3.2:1b"))


def toml_array(items: Column) -> Column:
    """A comma list as a TOML array; items are trimmed, a blank list is empty, quotes are not escaped."""
    parts = F.transform(F.split(items, ","), lambda x: F.concat(F.lit('"'), F.trim(x), F.lit('"')))
    return F.when(F.trim(items) == "", "[]").otherwise(F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")))
