"""Session helpers shared by every part of the library.

Nothing here runs a query of its own; these helpers decide *where* intermediate
tables live and make sure executors can import the package.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` when the session names one; else the checkpoint
    folder already set on the context; else, on a local master only, a fresh
    temporary folder; else a folder in the warehouse.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    java = sc._jsc.sc().getCheckpointDir()
    if java.isDefined():
        return str(java.get()).rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    else:
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera"
    sc.setCheckpointDir(own)
    return str(sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


class Scratch:
    """Intermediate tables of one query, written as Parquet in the shared folder.

    A written table cuts lineage and survives a lost executor: its readers
    never go back to the stages that made it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table (schema given, never inferred)."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}_{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later step reads."""
        path = getattr(df, "_tessera_path", None)
        if path:
            jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, as ``--py-files`` would; once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    where = Path(tempfile.mkdtemp(prefix="tessera-py-"), "tessera_lib.zip")
    where.write_bytes(body.getvalue())
    sc.addPyFile(os.fspath(where))
    sc._tessera_shipped = True


def likely(rows: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows whose id is in ``ids`` (one column), and a few others: at most one in 30 of these for up to 4 million ids.

    The ids are sent as a bitmap of their hashes, 16 MB at most, so that neither
    are they broadcast as rows nor are the rows shuffled.
    """
    ids = ids.toDF("id").where("id is not null")
    bits = min(max(15, (32 * ids.count()).bit_length()), 27)

    def place(c):
        return F.pmod(F.xxhash64(c, F.lit(21)), F.lit(1 << bits))

    p = F.col("p")
    marks = ids.select(place("id").alias("p")).groupBy(F.shiftright(p, 15).alias("_block")).agg(F.bitmap_construct_agg(p % 32768).alias("_bits"))
    at = place(column)
    byte = F.expr("substring(_bits, int(_at div 8) + 1, 1)")
    found = rows.withColumns({"_block": F.shiftright(at, 15), "_at": at % 32768}).join(F.broadcast(marks), "_block")
    found = found.where(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, int(_at % 8))")) != 0)
    return found.select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
