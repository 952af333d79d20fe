"""Operator 11: importance resampling of documents towards a target's word distribution.

Texts are lower-cased (A-Z only) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A feature
is a run of 1 to ``grams`` words, hashed by CRC-32 into ``buckets``.  A bucket's gain is the floored log
ratio (in thousandths) of its smoothed shares in the target and in the source; a document's weight is the
floored mean of its features' gains; Gumbel noise from a hash of the key makes the highest
``weight + noise`` a sample without replacement by importance.

Both passes run on Arrow kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten`` and
``dictionary_encode`` give words as dictionary indices; indices shifted against themselves give n-grams,
only the distinct ones of a block are hashed (a run's CRC continues that of the run
one word shorter); ``take`` and segment sums bring the gains back to the documents.

Counts are summed within a task first, so a task sends at most ``buckets`` rows.  The rank is built from
the histogram of scores, whose size is bounded by the range of a score and not by the rows, then
by counts of (score, key), so neither one score nor one often repeated key is numbered by one task.

Defined results: a null text has no words and weight 0; a null key's noise is that of the key '' and it
comes after every other key of the same score; of rows with the same score and key any order is valid,
each one has a rank of its own; equal texts under different keys have one weight and noise of their own; without a
target text all shares there are equal; an empty source gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptframe.session import ship_package

from .common import materialise, number
from .wordblocks import row_sums, split_words, text_slices

GRAMS = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Features(NamedTuple):
    """Bucket and row of every feature of a block, and the words of each row."""

    bucket: np.ndarray
    row: np.ndarray
    n_words: np.ndarray


def features(texts: pa.Array, grams: int = GRAMS, buckets: int = BUCKETS) -> Features:
    words = split_words(pc.ascii_lower(texts), SEPARATORS)
    row = words.rows
    spelled = words.dictionary.cast(pa.large_binary()).to_pylist()
    crc = np.fromiter((zlib.crc32(w) for w in spelled), np.int64, len(spelled))
    run = words.ids  # a run's number among the distinct runs of its size
    found = [(crc[run] % buckets, row)]
    for size in range(2, grams + 1):
        n = max(0, len(words.ids) - size + 1)
        inside = row[:n] == row[size - 1:] if n else np.zeros(0, bool)
        # The run one shorter at the same place, and the word after it.
        pair = np.flatnonzero(inside)
        shorter, last = run[pair] if size == 2 else run[np.searchsorted(at, pair)], words.ids[pair + size - 1]
        distinct, run = np.unique(shorter * max(1, len(spelled)) + last, return_inverse=True)
        of, word = np.divmod(distinct, max(1, len(spelled)))
        crc = np.fromiter((zlib.crc32(b" " + spelled[w], int(c)) for c, w in zip(crc[of], word)), np.int64, len(of))
        at = pair
        found.append((crc[run] % buckets, row[pair]))
    return Features(np.concatenate([b for b, _ in found]), np.concatenate([r for _, r in found]), np.diff(words.starts))


def bucket_counts(docs: DataFrame, text: str = "text", grams: int = GRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket; the driver gets one row a bucket."""
    ship_package(docs.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                total += np.bincount(features(texts, grams, buckets).bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some), "n": pa.array(total[some])})

    rows = (docs.select(F.col(f"`{text}`")).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of the smoothed shares."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.asarray([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
                       for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", grams: int = GRAMS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(gains)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        gain = shared.value
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                found = features(texts, grams, len(gain))
                order = np.argsort(found.row, kind="stable")
                n = np.bincount(found.row, minlength=len(texts))
                total = row_sums(gain[found.bucket[order]], np.concatenate([[0], np.cumsum(n)]))
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(found.n_words), pa.array(n), pa.array(weight)],
                    ["doc_id", "n_words", "n_features", "weight"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def with_scores(weighed: DataFrame, seed: str = SEED) -> DataFrame:
    """``weighed`` with ``score``: the weight and the Gumbel noise of the key, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise.cast("long"))


def draw(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored``, a stored table, with ``rank``: 1, 2, 3... of the drawn rows, null for the rest.

    Of the N rows with ``min_words`` words the ``percent * N // 100`` highest scores are drawn.
    """
    spark = scored.sparkSession
    able = scored.where(F.col("n_words") >= min_words)
    # One row for each value of a score: bounded by the range of weights and noise, not by the rows.
    sizes = sorted(((r[0], r[1]) for r in able.groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in sizes) // 100
    taken, before = [], 0
    for score, n in sizes:
        if before >= wanted:
            break
        taken.append((score, before))
        before += n
    least = taken[-1][0] if taken else None
    drawable = (F.col("n_words") >= min_words) & (F.col("score") >= F.lit(least).cast("long"))
    drawable = F.coalesce(drawable, F.lit(False))
    rest = scored.where(~drawable).withColumn("rank", F.lit(None).cast("long"))
    offsets = spark.createDataFrame(taken, "__score long, __before long")
    drawn = scored.where(drawable)
    # Rows of one (score, key) meet in a count before they are ordered, so that a key repeated often is one row here.
    groups = drawn.groupBy("score", "doc_id").agg(
        F.count(F.lit(1)).alias("__n"), F.min("n_words").alias("n_words"), F.min("n_features").alias("n_features"),
        F.min("weight").alias("weight"))
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.join(F.broadcast(offsets), F.col("score") == F.col("__score"))
    groups = groups.withColumn("__start", F.col("__before") + F.coalesce(F.sum("__n").over(within), F.lit(0)))
    groups = materialise(groups.drop("__score", "__before"), "resampling-groups")
    single = groups.where("__n = 1").withColumn("rank", F.col("__start") + 1)
    many = groups.where("__n > 1").select(F.col("score").alias("__score"), F.col("doc_id").alias("__id"), "__start")
    repeated = drawn.join(many, (F.col("score") == F.col("__score")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    if not many.isEmpty():
        repeated = materialise(repeated.withColumn("__spread", F.xxhash64(F.monotonically_increasing_id())),
                               "resampling-repeated")
        repeated = number(repeated, "__start", ["n_features"], "__spread", "__at")
        repeated = repeated.withColumn("rank", F.col("__start") + F.col("__at") + 1)
        single = single.select(*scored.columns, "rank").union(repeated.select(*scored.columns, "rank"))
    out = single.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return out.union(rest.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT,
             seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (and n_words) of every row of ``docs``."""
    gains = bucket_gains(bucket_counts(docs, text, grams, buckets), bucket_counts(target, target_text, grams, buckets))
    scored = materialise(with_scores(weigh(docs, gains, key, text, grams), seed), "resampling")
    return draw(scored, min_words, percent).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
