"""Substring search over many messages by posting lists of trigrams (PRJ10 at scale).

Every message is indexed once under its distinct lower-cased trigrams (three code points packed into one
number, so nothing collides).  A pattern looks up its ``RARE`` rarest trigrams only, by the counts kept beside the lists, so a
trigram that most messages hold is read just when a pattern has no rarer one; a message under all of them is a
candidate, and only candidates' texts are compared.  Patterns of fewer than three characters have no trigram: all
of them together are one scan.  The result is that of comparing every pattern with every message.

Lists are cut by a hash of the message's id before they are sorted, so the list of a hot trigram is no single
task's work.  A null message matches nothing, an empty pattern matches every other message, repeated ids are
repeated hits.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package

RARE = 3
PARTS = 16


def trigrams(text: str) -> np.ndarray:
    """Distinct trigrams of a text as 63-bit numbers."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(cp[:-2] << 42 | cp[1:-1] << 21 | cp[2:]) if len(cp) > 2 else np.zeros(0, np.int64)


class TrigramIndex(NamedTuple):
    """``messages`` (id, text in lower case), ``lists`` (gram, id) and ``counts`` (gram, n), all written tables."""

    messages: DataFrame
    lists: DataFrame
    counts: DataFrame


def _grams(batches):
    for batch in batches:
        found = [trigrams(t) for t in batch.column(1).to_pylist()]
        of = np.repeat(np.arange(len(found)), [len(f) for f in found])
        grams = np.concatenate(found) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(grams), batch.column(0).take(pa.array(of))], ["gram", "id"])


def build_trigrams(messages: DataFrame, id_col: str = "id", text_col: str = "message", path: str | None = None) -> TrigramIndex:
    """Index every message; written below ``path`` (default: the shared scratch folder)."""
    spark = messages.sparkSession
    ship_package(spark)
    path = path or scratch_path(spark, "trigrams")
    lowered = messages.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`")).alias("text"))
    lowered.where("text is not null").write.parquet(f"{path}/messages")
    own = spark.read.parquet(f"{path}/messages")
    schema = T.StructType([T.StructField("gram", T.LongType()), own.schema["id"]])
    dealt = own.mapInArrow(_grams, schema).repartition("gram", F.pmod(F.xxhash64("id"), F.lit(PARTS)))
    dealt.sortWithinPartitions("gram").write.parquet(f"{path}/lists")
    lists = spark.read.parquet(f"{path}/lists")
    lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/counts")
    return TrigramIndex(own, lists, spark.read.parquet(f"{path}/counts"))


def candidates(index: TrigramIndex, patterns: list[str]) -> DataFrame:
    """``pattern, id``: messages under the rarest trigrams of each pattern of three characters or more."""
    spark = index.messages.sparkSession
    rows = [(p, int(g)) for p in patterns for g in trigrams(p)]
    asked = spark.createDataFrame(rows, "pattern string, gram long")
    known = asked.join(index.counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("pattern").orderBy("n", "gram")  # as many rows as a pattern has trigrams
    rare = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= RARE)
    rare = rare.select("pattern", "gram", F.count(F.lit(1)).over(Window.partitionBy("pattern")).alias("wanted"))
    met = index.lists.join(F.broadcast(rare), "gram")  # RARE rows a pattern
    return (met.groupBy("pattern", "id", "wanted").agg(F.count_distinct("gram").alias("n")).where("n = wanted")
            .select("pattern", "id"))


def search_messages(index: TrigramIndex, patterns: list[str]) -> DataFrame:
    """``pattern, id`` of every message that holds the pattern, whatever the case; ``patterns`` as given."""
    spark = index.messages.sparkSession
    ship_package(spark)
    asked = spark.createDataFrame([(p,) for p in dict.fromkeys(patterns)], "pattern string")
    given = {r["pattern"]: r["low"] for r in asked.select("pattern", F.lower("pattern").alias("low")).collect()}
    long = sorted({low for low in given.values() if len(low) > 2})
    short = sorted({low for low in given.values() if len(low) <= 2})
    hits = spark.createDataFrame([], T.StructType([T.StructField("low", T.StringType()), index.messages.schema["id"]]))
    if long:
        held = candidates(index, long).join(index.messages, "id").where(F.contains("text", "pattern"))
        hits = hits.union(held.select(F.col("pattern").alias("low"), "id"))
    if short:
        held = F.filter(F.array(*[F.lit(p) for p in short]), lambda p: F.contains("text", p))
        hits = hits.union(index.messages.select(F.explode(held).alias("low"), "id"))
    names = spark.createDataFrame([(low, p) for p, low in given.items()], "low string, pattern string")
    return hits.join(F.broadcast(names), "low").select("pattern", "id")  # as many rows as patterns
