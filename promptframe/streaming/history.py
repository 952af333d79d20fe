"""Message history over a stream of appends (STM1).

Each micro-batch is merged into the retained state with the batch operators
of ``operators.history``: ``retained(state ∪ batch)``.  The state is bounded
(``cap`` rows per log) and kept in a parquet table under the shared
checkpoint folder with two slots, ``slot = epoch % 2``: epoch ``e`` reads the
newest version older than ``e`` (in the other slot) and replaces its own slot
with dynamic partition overwrite.  A retried batch therefore rewrites its own
version from the same input and never duplicates rows, and the table never
holds more than two versions.  Because retention keeps the newest ``max(ts)`` per
message, a late event with an old timestamp cannot move a message back, and
the state after the last batch equals the batch answer over all appends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.history import MAX_MESSAGE_COUNT, retained


def _latest_state(spark: SparkSession, state_path: str, before_epoch: int, schema) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        if before_epoch:  # the first epoch writes it; any other failure to read is raised too, never taken as empty
            raise FileNotFoundError(f"no message state at {state_path} before epoch {before_epoch}")
        return spark.createDataFrame([], schema)
    stored = StructType([*schema.fields, StructField("epoch", LongType()), StructField("slot", IntegerType())])
    versions = spark.read.schema(stored).parquet(state_path)
    prev = versions.where(F.col("epoch") < before_epoch).agg(F.max("epoch")).first()[0]
    if prev is None:
        return spark.createDataFrame([], schema)
    return versions.where((F.col("slot") == prev % 2) & (F.col("epoch") == prev)).drop("epoch", "slot")


def merge_batch(spark: SparkSession, batch: DataFrame, epoch_id: int, state_path: str, cap: int,
                log: str = "log", message: str = "message", ts: str = "ts") -> None:
    """foreachBatch body: state_{epoch} = retained(state_{epoch-1} ∪ batch)."""
    cols = [log, message, ts]
    b = batch.select(*cols)
    prev = _latest_state(spark, state_path, epoch_id, b.schema)
    nxt = retained(prev.select(*cols).unionByName(b), cap, log, message, ts)
    (nxt.withColumn("epoch", F.lit(epoch_id).cast("long")).withColumn("slot", F.lit(epoch_id % 2).cast("int"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot")
     .parquet(state_path))


def run_history_stream(stream: DataFrame, state_path: str, checkpoint_path: str, cap: int = MAX_MESSAGE_COUNT,
                       log: str = "log", message: str = "message", ts: str = "ts",
                       available_now: bool = True, processing_time: str | None = None):
    """Start the stream; with ``available_now`` it drains the source and stops."""
    spark = stream.sparkSession
    writer = (stream.writeStream
              .foreachBatch(lambda df, epoch: merge_batch(spark, df, epoch, state_path, cap, log, message, ts))
              .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time
                                                                                     or "10 seconds")
    return writer.start()


def current_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest state version (log, message, ts)."""
    versions = spark.read.parquet(state_path)
    last = versions.agg(F.max("epoch")).first()[0]
    return versions.where((F.col("slot") == last % 2) & (F.col("epoch") == last)).drop("epoch", "slot")
