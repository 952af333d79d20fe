"""Bounded message history (HIS1-HIS4, JN6, PRJ10, DT1-DT2).

The reference keeps ten SQLite tables ``(timestamp, message)``; appending a
message inserts it or touches its timestamp, then drops the oldest row when
the table holds more than ``max_message_count`` (128).  Because each append
is insert-or-touch followed by evict-oldest, the table after any sequence of
appends is an LRU cache: the ``cap`` messages with the newest last-use
timestamps.  So a whole log of appends is replayed in two set operations:

1. ``latest``: one row per (log, message) with ``max(ts)`` (a partial hash
   aggregate), and
2. ``retained``: the ``cap`` newest rows per log, as ``row_number() <= cap``.
   Spark plans this as a *partial* ``WindowGroupLimit`` before the shuffle,
   so each task forwards at most ``cap`` rows per log: a log holding a third
   of all events costs ``cap`` rows per task, not a third of the data in one
   task.

Ties on the timestamp are broken by message, so exactly ``cap`` rows stay
(the reference deletes every row tied at the minimum).  Null messages never
match in SQL and would pile up; they are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncate

MAX_MESSAGE_COUNT = 128
MAX_MESSAGE_LENGTH = 65535


def latest(events: DataFrame, log: str = "log", message: str = "message", ts: str = "ts") -> DataFrame:
    """Append-or-touch over a log of appends (HIS1, DT2): newest ts per message."""
    return (events.where(F.col(message).isNotNull())
            .groupBy(log, message).agg(F.max(ts).alias(ts)))


def retained(events: DataFrame, cap: int = MAX_MESSAGE_COUNT, log: str = "log", message: str = "message",
             ts: str = "ts", rank: str | None = None) -> DataFrame:
    """The ``cap`` most recently used messages per log (HIS2)."""
    w = Window.partitionBy(log).orderBy(F.col(ts).desc(), F.col(message))
    ranked = latest(events, log, message, ts).withColumn("__rn", F.row_number().over(w))
    kept = ranked.where(F.col("__rn") <= int(cap))
    return kept.withColumnRenamed("__rn", rank) if rank else kept.drop("__rn")


def listing(events: DataFrame, cap: int = MAX_MESSAGE_COUNT, max_length: int = MAX_MESSAGE_LENGTH,
            log: str = "log", message: str = "message", ts: str = "ts") -> DataFrame:
    """Messages newest first, truncated to ``max_length`` (HIS3, STR6).

    Output: ``log, rank`` (1 = newest), ``ts, message``; the rank carries the
    order, so no global sort is needed.
    """
    r = retained(events, cap, log, message, ts, rank="rank")
    return r.select(log, F.col("rank").cast("int").alias("rank"), ts, truncate(message, max_length).alias(message))


def reload(listed: DataFrame, log: str = "log", message: str = "message") -> DataFrame:
    """All logs at once, each as its newest-first message list (HIS4).

    The list per log is bounded by the retention cap.
    """
    return listed.groupBy(log).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", message))), lambda s: s[message]).alias("messages"))


def filter_messages(listed: DataFrame, query_text: str | None, log: str = "log",
                    message: str = "message") -> DataFrame:
    """Case-insensitive substring filter over each log's listing (PRJ10).

    A blank query keeps everything; so does a query whose only match is the
    query itself (the dropdown keeps all choices then).  The window is over a
    listing, which holds at most ``cap`` rows per log.
    """
    if query_text is None or query_text.strip() == "":
        return listed
    hit = F.contains(F.lower(F.col(message)), F.lit(query_text.lower()))
    w = Window.partitionBy(log)
    staged = listed.withColumn("__hit", hit) \
        .withColumn("__n", F.sum(F.col("__hit").cast("int")).over(w)) \
        .withColumn("__exact", F.max((F.col("__hit") & (F.col(message) == query_text)).cast("int")).over(w))
    keep_all = (F.col("__n") == 1) & (F.col("__exact") == 1)
    return staged.where(keep_all | F.col("__hit")).drop("__hit", "__n", "__exact")


def exists(history: DataFrame, candidates: DataFrame, log: str = "log", message: str = "message") -> DataFrame:
    """Candidates whose message is already in the log (JN6), as a semi join."""
    return candidates.join(history.select(log, message), [log, message], "left_semi")


def beijing_time(ts_col, ntz: bool = True):
    """UTC timestamp shown as Beijing time (DT1).

    The reference adds 8 hours to local time (right only on a UTC host); a
    UTC ``timestamp_ntz`` plus 8 hours is the correct reading anywhere.
    """
    c = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    if ntz:
        return c + F.expr("INTERVAL 8 HOURS")
    return F.from_utc_timestamp(c, "Asia/Shanghai")
