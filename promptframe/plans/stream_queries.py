"""Streaming queries: the stream's final answer must equal the batch answer.

The input table is first written by Spark as several parquet files under the
shared checkpoint folder, then replayed as a file stream a few files per
micro-batch (``availableNow``), so state is carried across batches.
"""

from __future__ import annotations

from ..session import scratch_path, ship_package
from ..streaming.history import current_state, run_history_stream
from ..streaming.llm import llm_stream
from .history_queries import CAP, appends
from .llm_queries import CLIENT, SYSTEM, USER, _customers
from .registry import ORACLES, query


def _replay_dir(df, name, files=8):
    path = scratch_path(df.sparkSession, name)
    df.repartition(files).write.parquet(path)
    return path


@query("history_stream")
def q_history_stream(spark, sf_dir):
    src = _replay_dir(appends(spark, sf_dir), "stream-appends")
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
    base = scratch_path(spark, "history-stream")
    q = run_history_stream(stream, f"{base}/state", f"{base}/_checkpoint", cap=CAP)
    q.awaitTermination()
    return current_state(spark, f"{base}/state")


@query("llm_stream")
def q_llm_stream(spark, sf_dir):
    ship_package(spark)
    src = _replay_dir(_customers(spark, sf_dir), "stream-customers")
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
    base = scratch_path(spark, "llm-stream")
    q = llm_stream(stream, SYSTEM, USER, CLIENT, f"{base}/out", f"{base}/_checkpoint",
                   keep=["c_custkey", "c_name", "c_mktsegment"])
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("c_custkey", "c_name", "c_mktsegment", "Output", "status")


# Same answers as the batch queries.
ORACLES["history_stream"] = ORACLES["history_retained"]
ORACLES["llm_stream"] = ORACLES["llm_batch"]
