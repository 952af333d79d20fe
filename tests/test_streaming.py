"""Streams must end in the batch answer; npy round trip."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from promptframe.operators import history as H
from promptframe.session import scratch_path, ship_package
from promptframe.sources import npy
from promptframe.streaming.history import current_state, run_history_stream
from promptframe.streaming.llm import llm_stream

from .conftest import rows


def _replay(spark, df, name, files=6):
    path = scratch_path(spark, name)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)


def test_history_stream_equals_batch_with_late_events(spark):
    base = dt.datetime(2024, 1, 1)
    events = [("a" if i % 3 else "b", base + dt.timedelta(seconds=(i * 37) % 500), f"m{(i * 13) % 41}")
              for i in range(600)]
    df = spark.createDataFrame(events, "log string, ts timestamp_ntz, message string")
    root = scratch_path(spark, "t-hstream")
    q = run_history_stream(_replay(spark, df, "t-hsrc"), f"{root}/state", f"{root}/ckpt", cap=7)
    q.awaitTermination()
    assert rows(current_state(spark, f"{root}/state")) == rows(H.retained(df, cap=7))


def test_llm_stream_equals_batch(spark):
    from promptframe.operators.llm import llm_batch

    ship_package(spark)
    df = spark.createDataFrame([("" if i % 4 else "skip", f"r{i}", i) for i in range(40)],
                               "Skip string, role string, k int")
    root = scratch_path(spark, "t-lstream")
    q = llm_stream(_replay(spark, df, "t-lsrc"), "You are {role}.", "Go.", {"type": "md5-echo"}, f"{root}/out",
                   f"{root}/ckpt", keep=["k"])
    q.awaitTermination()
    got = rows(spark.read.parquet(f"{root}/out").select("k", "Output"))
    want = rows(llm_batch(df, "You are {role}.", "Go.", {"type": "md5-echo"}, keep=["k"]).select("k", "Output"))
    assert got == want and len(got) == 30


def test_npy_round_trip_ranges(spark):
    ship_package(spark)
    npy.register(spark)
    path = scratch_path(spark, "t-npy")
    df = spark.range(0, 257).select(F.col("id"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float"))
                                    .alias("v")).orderBy("id")
    df.write.format("npy").option("column", "v").mode("overwrite").save(path)
    back = spark.read.format("npy").option("rowsPerPartition", 50).load(path)
    got = sorted((r["pos"], tuple(r["vector"])) for r in back.collect())
    assert got == [(i, (float(i), 0.5)) for i in range(257)]


def test_file_writers_overwrite_and_append(spark):
    from promptframe.sources import xlsx

    ship_package(spark)
    npy.register(spark)
    xlsx.register(spark)
    vecs = lambda lo, hi, parts: spark.range(lo, hi, numPartitions=parts).select(
        F.array(F.col("id").cast("float")).alias("v"))
    path = scratch_path(spark, "t-npy-modes")
    vecs(0, 40, 4).write.format("npy").option("column", "v").mode("overwrite").save(path)
    vecs(100, 110, 2).write.format("npy").option("column", "v").mode("overwrite").save(path)
    got = [r["vector"][0] for r in spark.read.format("npy").load(path).orderBy("pos").collect()]
    assert got == [float(i) for i in range(100, 110)]                     # stale parts removed
    vecs(200, 205, 1).write.format("npy").option("column", "v").mode("append").save(path)
    got = [r["vector"][0] for r in spark.read.format("npy").load(path).orderBy("pos").collect()]
    assert got == [float(i) for i in range(100, 110)] + [float(i) for i in range(200, 205)]   # append, in order

    book = scratch_path(spark, "t-xlsx-modes")
    spark.range(0, 30, numPartitions=3).write.format("xlsx").mode("overwrite").save(book)
    spark.range(50, 52, numPartitions=1).write.format("xlsx").mode("overwrite").save(book)
    spark.range(60, 61, numPartitions=1).write.format("xlsx").mode("append").save(book)
    assert sorted(int(r["id"]) for r in spark.read.format("xlsx").load(book).collect()) == [50, 51, 60]
