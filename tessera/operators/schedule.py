"""One lease at a time: model switches, runs of one model, and queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import with_running


def switches(requests: DataFrame, arrival: str = "arrival", tie: str = "req_id", model: str = "model") -> DataFrame:
    """``requests`` with outcome (cold, hot, switch) and active_users, the place within a run of one model.

    Users of a run are never given back before it ends. ``arrival`` is a timestamp.
    """
    order = [arrival, tie]
    out = with_running(requests, order, {"prev_model": ("lag", F.col(model)), "position": ("sum", F.lit(1))})
    new = F.col("prev_model").isNull() | (F.col("prev_model") != F.col(model))
    out = out.withColumn("_new", F.when(new, F.col("position")))
    out = with_running(out, order, {"run_start": ("max", F.col("_new"))})
    outcome = F.when(F.col("prev_model").isNull(), "cold").when(F.col("prev_model") == F.col(model), "hot").otherwise("switch")
    return out.withColumn("outcome", outcome).withColumn("active_users", F.col("position") - F.col("run_start") + 1).drop("_new", "run_start", "position")


def queue(requests: DataFrame, arrival: str = "arrival", tie: str = "req_id", duration: str = "duration_us") -> DataFrame:
    """``requests`` with start_us and finish_us under a single lease, first come first served.

    A finish is the running sum of durations plus the running maximum of each
    arrival less the durations before it, so no fold is needed.
    """
    at = F.unix_micros(F.col(arrival).cast("timestamp"))
    order = [arrival, tie]
    out = with_running(requests, order, {"_sum": ("sum", F.col(duration))})
    out = with_running(out, order, {"_wait": ("max", at - (F.col("_sum") - F.col(duration)))})
    finish = F.col("_sum") + F.col("_wait")
    return out.withColumn("start_us", finish - F.col(duration)).withColumn("finish_us", finish).drop("_sum", "_wait")


def status(switched: DataFrame, arrival: str = "arrival", tie: str = "req_id", model: str = "model") -> DataFrame:
    """One row: the model of the last request and its users, as text."""
    last = switched.agg(F.max_by(F.struct(F.col(model).alias("m"), F.col("active_users").alias("u")), F.struct(arrival, tie)).alias("s"))
    return last.select(F.when(F.col("s").isNull(), "idle").otherwise(F.concat(F.lit("active: "), F.col("s.m"), F.lit(", users: "), F.col("s.u").cast("string"))).alias("status"))
