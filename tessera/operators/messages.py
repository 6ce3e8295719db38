"""First-in, first-out queues of messages, one for each receiver."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import catalog

#: Tokens of one reply at most.
MOST_TOKENS = 8192


def deliver(messages: DataFrame, manifests: DataFrame) -> DataFrame:
    """The messages whose registered sender holds the grant for the receiver; the receiver need not be registered."""
    return catalog.allowed(messages, catalog.registry(manifests), "agent", "from_app", "to_app")


def poll(queue: DataFrame, n: int = 1, taken: int = 0) -> DataFrame:
    """What polls ``taken`` + 1 to ``taken`` + n of each receiver give: nth from 1. An empty queue gives no row."""
    order = Window.partitionBy("to_app").orderBy("seq")
    return queue.withColumn("nth", F.row_number().over(order)).where((F.col("nth") > taken) & (F.col("nth") <= taken + n))


def after(queue: DataFrame, taken: int) -> DataFrame:
    """The queue that polls have left."""
    order = Window.partitionBy("to_app").orderBy("seq")
    return queue.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > taken).drop("_n")


def stream_tokens(tokens: DataFrame, order: str = "i", token: str = "token", most: int = MOST_TOKENS) -> Iterator[str]:
    """A reply's tokens one by one, in order, at most ``most``; the driver holds one partition at a time.

    A reader that stops early closes the iterator, and no further partition is run.
    """
    for r in tokens.where(F.col(token).isNotNull()).orderBy(order).limit(most).select(token).toLocalIterator():
        yield r[0]


def replies(tokens: DataFrame, stops: list[str], key: str = "reply_id", order: str = "i", token: str = "token", most: int = MOST_TOKENS) -> DataFrame:
    """The tokens of many replies that are sent: those before each reply's first stop token, at most ``most``."""
    end = tokens.where(F.col(token).isin(*stops)).groupBy(key).agg(F.min(order).alias("_end"))
    nth = Window.partitionBy(key).orderBy(order)
    sent = tokens.join(end, key, "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).drop("_end")
    return sent.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= most).drop("_n")
