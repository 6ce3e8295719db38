"""The stateful operators over streams.

Rows of a micro-batch come unordered, so each processor sorts its batch. The
watermark and what follows from it are this library's own; the batch operators
give the same rows when the stream is replayed in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.admission import WINDOW_US, Budget
from tessera.runtime import ship

#: Event time runs so far ahead of the clock, because a stream's watermark begins at 1970 and what lies before it is late.
AHEAD_DAYS = 36_525
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """Admits or denies requests by key: a value state of what is used and when the window began.

    Once the watermark has passed a window's end, any request that still comes
    begins a new one, so the state goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("budget", "used long, start long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_us", "req_id"])
        had = self.state.get()
        budget = Budget(*had) if had else Budget()
        admitted = [budget.admit(int(a), int(c), int(m)) for a, c, m in zip(batch.at_us, batch.cost, batch.limit, strict=True)]
        if not had or had[1] != budget.start:
            if had:
                self.handle.deleteTimer(_ends_ms(had[1]))
            self.handle.registerTimer(_ends_ms(budget.start))
        self.state.update((budget.used, budget.start))
        yield pd.DataFrame({"app_id": batch.app_id, "req_id": batch.req_id, "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"app_id": pd.Series([], dtype=str), "req_id": pd.Series([], dtype="int64"), "admitted": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def _ends_ms(start_us: int) -> int:
    """The first millisecond of event time that lies wholly beyond the window."""
    return (start_us + WINDOW_US) // 1000 + 1 + AHEAD_DAYS * 86_400_000


class Queue(StatefulProcessor):
    """Numbers a receiver's messages in arrival order and keeps those not yet polled.

    Rows are sends (payload) or polls (is_poll); a poll takes the oldest message
    or gives null. Messages are a map by number, with the first and the next
    number beside it, so a batch touches only what it sends and polls. A message
    stays until it is polled, whatever its age.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "first long, next long")
        self.waiting = handle.getMapState("waiting", "n long", "seq long, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, after = self.ends.get() or (0, 0)
        new: dict[int, tuple[int, str]] = {}
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if not r.is_poll:
                new[after] = (int(r.seq), r.payload)
                after += 1
            elif first == after:
                out.append((key[0], int(r.seq), None, None))
            else:
                got = new.pop(first, None)
                if got is None:
                    got = self.waiting.getValue((first,))
                    self.waiting.removeKey((first,))
                out.append((key[0], int(r.seq), *got))
                first += 1
        for n, message in new.items():
            self.waiting.updateValue((n,), message)
        if first == after:
            self.ends.clear()
        else:
            self.ends.update((first, after))
        yield pd.DataFrame(out, columns=["to_app", "poll_seq", "message_seq", "payload"]).astype({"message_seq": "Int64"})

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, limit: int, lateness: str = "1 minute") -> DataFrame:
    """(app_id, req_id, admitted) for a stream of app_id, ts, req_id, cost; requests later than the watermark are dropped."""
    ship(requests.sparkSession)
    ts = F.col("ts").cast("timestamp")
    rows = requests.select((ts + F.make_dt_interval(F.lit(AHEAD_DAYS))).alias("event"), "app_id", F.unix_micros(ts).alias("at_us"), "req_id", F.col("cost").cast("long").alias("cost"), F.lit(limit).cast("long").alias("limit"))
    rows = rows.withWatermark("event", lateness)
    return rows.groupBy("app_id").transformWithStateInPandas(Admission(), "app_id string, req_id long, admitted boolean", "Append", "EventTime")


def queue_stream(messages: DataFrame) -> DataFrame:
    """(to_app, poll_seq, message_seq, payload) for a stream of to_app, seq, payload, is_poll."""
    ship(messages.sparkSession)
    return messages.groupBy("to_app").transformWithStateInPandas(Queue(), "to_app string, poll_seq long, message_seq long, payload string", "Append", "None")


def live_chunks(chunks: DataFrame, ttl: str, ts: str = "ts") -> DataFrame:
    """A stream's chunks within the watermark, each text of a pipe once: state older than ``ttl`` is dropped."""
    return chunks.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(["pipe", "text"])
