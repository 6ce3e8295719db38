"""Token budgets per application, one window at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordered import with_running
from tessera.runtime import ship

WINDOW_US = 60_000_000
COST = 1000


class Budget:
    """The state of one key: what is used, and when its window began.

    A window begins with the key's first request and is reset by the first one
    more than 60 s after; a request beyond the limit is denied and costs nothing.
    """

    __slots__ = ("start", "used")

    def __init__(self, used: int = 0, start: int | None = None):
        self.used, self.start = used, start

    def admit(self, at: int, cost: int, limit: int) -> bool:
        if self.start is None:
            self.start = at
        elif at - self.start > WINDOW_US:
            self.used, self.start = 0, at
        if self.used + cost > limit:
            return False
        self.used += cost
        return True


def admit(requests: DataFrame, default_limit: int | None = None) -> DataFrame:
    """``requests`` (app_id, ts, req_id, cost, and limit unless a default is given) with admitted.

    A decision depends on those before it, but never across a pause longer than a
    window: the first request after one begins anew. So a key's requests are cut
    at such pauses (found by running values over ranges of the order, not key by
    key) and each stretch is read in order by one task; stretches stream through
    it, sorted by Spark, and only a stretch's state is held.
    """
    ship(requests.sparkSession)
    rows = requests.withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))
    if default_limit is not None:
        rows = rows.withColumn("limit", F.lit(default_limit).cast("long"))
    rows = rows.select("app_id", "req_id", "at_us", F.col("cost").cast("long").alias("cost"), F.col("limit").cast("long").alias("limit"))
    order = ["app_id", "at_us", "req_id"]
    before = with_running(rows, order, {"_last": ("lag", F.struct("app_id", "at_us"))})
    new = F.col("_last").isNull() | ~F.col("_last.app_id").eqNullSafe(F.col("app_id")) | (F.col("at_us") - F.col("_last.at_us") > WINDOW_US)
    cut = with_running(before.withColumn("_new", new.cast("long")).drop("_last"), order, {"stretch": ("sum", F.col("_new"))})
    cut = cut.drop("_new").repartition("stretch").sortWithinPartitions("stretch", "at_us", "req_id")
    schema = "app_id string, req_id long, at_us long, cost long, admitted boolean"

    def run(batches):
        now, state = None, None
        for b in batches:
            out = []
            for stretch, at, cost, limit in zip(b["stretch"], b["at_us"], b["cost"], b["limit"], strict=True):
                if stretch != now:
                    now, state = stretch, Budget()
                out.append(state.admit(at, cost, limit))
            yield b[["app_id", "req_id", "at_us", "cost"]].assign(admitted=out)

    return cut.mapInPandas(run, schema)
