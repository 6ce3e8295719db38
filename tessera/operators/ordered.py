"""Running values over one global order, without one task that sees all rows.

Rows are cut into ranges of the order, of about equal numbers of rows whatever
the values are (Spark samples them), and written with the range's number. A
running value within a range is a window partitioned by it; what came before a
range is a running value over the ranges' summaries, a row each, and is joined
back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import Scratch


def with_running(df: DataFrame, order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with a column for each of ``values``: name -> (kind, column).

    kind is 'sum' or 'max' (up to and including the row; null for none yet) or
    'lag' (the row before). ``order`` names columns that tell all rows apart.
    """
    ranged = df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id())
    df = Scratch(df.sparkSession, "ordered").write(ranged, "ranges")
    here = Window.partitionBy("_b").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts, sums, before = [], [], []
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, col) in values.items():
        df = df.withColumn(f"_v_{name}", col)
        v = F.col(f"_v_{name}")
        if kind == "lag":
            parts.append((name, F.lag(v).over(here)))
            sums.append(F.max_by(v, F.struct(*order)).alias(f"_s_{name}"))
            before.append(F.last(f"_s_{name}").over(earlier).alias(f"_p_{name}"))
        else:
            fn = F.sum if kind == "sum" else F.max
            parts.append((name, fn(v).over(upto)))
            sums.append(fn(v).alias(f"_s_{name}"))
            before.append(fn(f"_s_{name}").over(earlier).alias(f"_p_{name}"))
    summary = df.groupBy("_b").agg(*sums).select("_b", *before)
    out = df.withColumn("_first", F.row_number().over(here) == 1)
    for name, col in parts:
        out = out.withColumn(f"_l_{name}", col)
    out = out.join(summary, "_b")
    for name, (kind, _) in values.items():
        mine, past = F.col(f"_l_{name}"), F.col(f"_p_{name}")
        if kind == "lag":
            value = F.when(F.col("_first"), past).otherwise(mine)
        elif kind == "sum":
            value = F.coalesce(mine + past, mine, past)
        else:
            value = F.greatest(mine, past)
        out = out.withColumn(name, value)
    return out.drop("_b", "_first", *(f"_{p}_{n}" for n in values for p in "vlp"))
