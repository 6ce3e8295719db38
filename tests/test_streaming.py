"""Streams replayed in several micro-batches against the batch operators."""

import random

from pyspark.sql import functions as F

from tessera.operators import admission
from tessera.streaming import processors


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.read.parquet(f"{tmp_path}/{name}").collect()


def test_admission_is_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.STORE)
    rnd = random.Random(1)
    rows, t = [], 0
    for i in range(300):
        t += rnd.choice([0, 1_000_000, 30_000_000])
        rows.append((f"a{rnd.randrange(5)}", t, i, 1000))
    schema = "app_id string, us long, req_id long, cost int"
    for k in range(3):  # files are read in order of age, one a batch
        spark.createDataFrame(rows[100 * k : 100 * k + 100], schema).select("app_id", F.timestamp_micros("us").alias("ts"), "req_id", "cost").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    every = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.req_id: r.admitted for r in run(spark, processors.admit_stream(stream, 2500), tmp_path, "out")}
    assert got == {r.req_id: r.admitted for r in admission.admit(every, 2500).collect()}


def test_queue(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", processors.STORE)
    rows = [("x", 1, "a", False), ("x", 2, "b", False), ("y", 3, None, True), ("x", 4, None, True), ("x", 5, None, True), ("x", 6, None, True), ("y", 7, "c", False), ("y", 8, None, True)]
    spark.createDataFrame(rows, "to_app string, seq long, payload string, is_poll boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("to_app string, seq long, payload string, is_poll boolean").parquet(f"{tmp_path}/in")
    got = {r.poll_seq: r.payload for r in run(spark, processors.queue_stream(stream), tmp_path, "out")}
    assert got == {3: None, 4: "a", 5: "b", 6: None, 8: "c"}
