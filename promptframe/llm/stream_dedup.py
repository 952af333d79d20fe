"""Operator 8: exact deduplication with keyed streaming state (native).

A stream of (digest, stable id, content locator) rows is folded into keyed
state: one entry per digest with the largest id, the locator of that id's
content and the number of rows.  The state has no watermark, so nothing ever
expires; it lives in RocksDB (on the executors' disks, not their heaps), and its
snapshots go to the query's checkpoint in the shared folder, where they are read
back as a table and from where a later run goes on.  Partial aggregation before
the shuffle leaves one row per digest and task, so a group of copies that holds
a third of all rows is no hot key.

A digest alone never drops a row: every row that hits a digest is joined with
the retained content by its locator, and its whole bytes are compared.  Rows that differ
under one digest are grouped anew by their bytes.

Defined results: a null text counts as empty; the row with the largest id of
equal texts stays (a null id is below all others; of repeated rows with that id one,
by the row's number, stays); empty tables give empty results; other columns ride along in
:func:`deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptframe.session import scratch_path

from .common import materialise, numbered, quoted, text_or_empty, with_rows

#: State on disk; with many state partitions the space that RocksDB would set aside for each one's
#: log files (some MB) outgrows the state itself, so nothing is set aside.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
ENTRY = "digest string, id long, locator long"


def arrivals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, id, locator) of every row; the locator is the row's number in ``docs``.

    ``docs`` must be a table read from Parquet files (see :func:`numbered`).
    """
    own = {"digest": F.sha2(text_or_empty(quoted(text_col)).cast("binary"), 256), "id": F.col(quoted(id_col)).cast("long")}
    return numbered(docs, "locator", **own).select("digest", "id", "locator")


def fold(stream: DataFrame) -> DataFrame:
    """The streaming aggregation that keeps the state: one entry per digest."""
    newest = F.max(F.struct("id", "locator"))
    return stream.groupBy("digest").agg(newest.alias("keep"), F.count(F.lit(1)).alias("group_size"))


def run_state(spark: SparkSession, entries_path: str, checkpoint: str) -> None:
    """Fold all files below ``entries_path`` that are new since the last run into the state at ``checkpoint``."""
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        query = (fold(spark.readStream.schema(ENTRY).parquet(entries_path)).writeStream.outputMode("update")
                 .format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The retained entries: digest, keep_id, keep_locator, group_size."""
    state = spark.read.format("statestore").load(checkpoint)
    entry = F.col("value")
    names = state.schema["value"].dataType.names
    keep, size = names[0], names[1]
    return state.select(F.col("key.digest").alias("digest"), entry[keep]["id"].alias("keep_id"),
                        entry[keep]["locator"].alias("keep_locator"), entry[size].alias("group_size"))


def dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: locator, id, keep_id, keep_locator, group_size, kept, digest."""
    spark = docs.sparkSession
    entries, checkpoint = scratch_path(spark, "dedup-entries"), scratch_path(spark, "dedup-state")
    seen = arrivals(docs, id_col, text_col)
    seen.write.parquet(entries)
    seen = spark.read.schema(ENTRY).parquet(entries)
    if seen.isEmpty():
        state = spark.createDataFrame([], "digest string, keep_id long, keep_locator long, group_size long")
    else:
        run_state(spark, entries, checkpoint)
        state = read_state(spark, checkpoint)
    found = materialise(seen.join(state, "digest"), "dedup-found")
    hits = found.where("group_size > 1")
    # Full bytes: each hit's text against the retained one's.  All texts are shuffled once; after that only hits.
    texts = numbered(docs, "locator", __text=text_or_empty(quoted(text_col)))
    hits = materialise(hits.join(texts, "locator"), "dedup-hits")
    retained = hits.where("locator = keep_locator").select("keep_locator", F.col("__text").alias("__kept"))
    compared = hits.join(retained, "keep_locator").withColumn("__same", F.col("__text") == F.col("__kept"))
    compared = compared.drop("__kept")
    compared = materialise(compared.withColumn("__text", F.when(~F.col("__same"), F.col("__text"))), "dedup-compared")
    differing = compared.where("not __same")
    if differing.isEmpty():  # no digest of this table covers two texts
        return found.withColumn("kept", F.col("locator") == F.col("keep_locator"))
    return regroup(found, compared)


def regroup(found: DataFrame, compared: DataFrame) -> DataFrame:
    """Groups by bytes for the rows whose digest also covers another text."""
    other = compared.where("not __same")
    own = other.groupBy("digest", "__text").agg(F.max(F.struct("id", "locator")).alias("k"),
                                                F.count(F.lit(1)).alias("n"))
    other = other.join(own, ["digest", "__text"]).select(
        "digest", "id", "locator", F.col("k.id").alias("keep_id"), F.col("k.locator").alias("keep_locator"),
        F.col("n").alias("group_size"))
    lost = own.groupBy("digest").agg(F.sum("n").alias("__lost"))
    rest = (found.join(other.select("locator"), "locator", "left_anti").join(lost, "digest", "left")
            .withColumn("group_size", F.col("group_size") - F.coalesce("__lost", F.lit(0))))
    both = rest.select(*other.columns).unionByName(other)
    return both.withColumn("kept", F.col("locator") == F.col("keep_locator"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return with_rows(docs, dedup_decisions(docs, id_col, text_col).where("kept"), "locator", "left_semi")
