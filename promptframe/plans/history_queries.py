"""Message-history and catalog queries.

The event stream is a log of appends: ``log = event_type``, ``message =
'user ' || user_id``, ``ts`` the event time.  The cap is 50 so that retention
bites at every scale factor.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import history as H
from ..operators.trigrams import build_trigrams, search_messages
from ..session import table
from .registry import query

CAP = 50
FILTER = "USER 14"

_APPENDS_SQL = "SELECT event_type AS log, 'user ' || user_id AS message, ts FROM events"
_LATEST_SQL = f"SELECT log, message, max(ts) AS ts FROM ({_APPENDS_SQL}) GROUP BY log, message"
_LIST_SQL = f"""
SELECT log, CAST(rank AS INTEGER) AS rank, ts, substr(coalesce(message, ''), 1, 65535) AS message FROM (
  SELECT *, row_number() OVER (PARTITION BY log ORDER BY ts DESC, message) AS rank FROM ({_LATEST_SQL}))
WHERE rank <= {CAP}
"""


def appends(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("log"),
                    F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("message"), "ts")


@query("history_latest", _LATEST_SQL)
def q_history_latest(spark, sf_dir):
    return H.latest(appends(spark, sf_dir))


@query("history_retained", f"""
SELECT log, message, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY log ORDER BY ts DESC, message) AS rn FROM ({_LATEST_SQL}))
WHERE rn <= {CAP}
""")
def q_history_retained(spark, sf_dir):
    return H.retained(appends(spark, sf_dir), CAP)


@query("history_list", _LIST_SQL)
def q_history_list(spark, sf_dir):
    return H.listing(appends(spark, sf_dir), CAP)


@query("history_filter", f"""
WITH l AS ({_LIST_SQL}),
f AS (SELECT *, contains(lower(message), lower('{FILTER}')) AS hit FROM l),
g AS (SELECT *, sum(hit::INT) OVER (PARTITION BY log) AS n,
             max((hit AND message = '{FILTER}')::INT) OVER (PARTITION BY log) AS ex FROM f)
SELECT log, rank, ts, message FROM g WHERE (n = 1 AND ex = 1) OR hit
""")
def q_history_filter(spark, sf_dir):
    return H.filter_messages(H.listing(appends(spark, sf_dir), CAP), FILTER)


SEARCHED = ["The", "ing on", "é", "secret_key", "lich ", "no such words at all", "QU"]


@query("history_search", f"""
SELECT pattern, doc_id FROM documents, (VALUES {", ".join(f"('{p}')" for p in SEARCHED)}) p(pattern)
WHERE contains(lower(text), lower(pattern))
""")
def q_history_search(spark, sf_dir):
    """Several patterns over all texts by posting lists; hits are compared exactly."""
    index = build_trigrams(table(spark, sf_dir, "documents"), "doc_id", "text")
    return search_messages(index, SEARCHED).withColumnRenamed("id", "doc_id")


@query("history_reload", f"""
SELECT log, string_agg(message, '|' ORDER BY rank) AS messages FROM ({_LIST_SQL}) GROUP BY log
""")
def q_history_reload(spark, sf_dir):
    r = H.reload(H.listing(appends(spark, sf_dir), CAP))
    return r.select("log", F.array_join("messages", "|").alias("messages"))


@query("history_exists", f"""
SELECT c.log, c.message FROM (SELECT 'click' AS log, 'user ' || c_custkey AS message FROM customer) c
WHERE EXISTS (SELECT 1 FROM ({_LATEST_SQL}) h WHERE h.log = c.log AND h.message = c.message)
""")
def q_history_exists(spark, sf_dir):
    cand = table(spark, sf_dir, "customer").select(
        F.lit("click").alias("log"), F.concat(F.lit("user "), F.col("c_custkey").cast("string")).alias("message"))
    return H.exists(H.latest(appends(spark, sf_dir)), cand)


@query("beijing_time", "SELECT event_id, ts, ts + INTERVAL 8 HOUR AS ts_beijing FROM events")
def q_beijing_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", H.beijing_time("ts").alias("ts_beijing"))


# Catalog listings derived from parts: each part publishes a listing of two
# model ids, one from its brand and name, one from its type.
def _listings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    brand_id = F.concat(F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit("/"),
                        F.regexp_replace("p_name", " ", "-"))
    type_id = F.concat(F.lit("type/"), F.regexp_replace(F.lower("p_type"), " ", "-"))
    payload = F.concat(F.lit('{"data":[{"id":"'), brand_id, F.lit('","name":"'), F.col("p_name"),
                       F.lit('"},{"id":"'), type_id, F.lit('"}]}'))
    return p.select("p_partkey", payload.alias("payload"))


_LISTINGS_SQL = """
SELECT p_partkey, '{"data":[{"id":"' || lower(replace(p_brand, '#', '-')) || '/' || replace(p_name, ' ', '-')
  || '","name":"' || p_name || '"},{"id":"type/' || replace(lower(p_type), ' ', '-') || '"}]}' AS payload FROM part
"""
_IDS_SQL = f"""
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS idx, ids[i] AS id FROM (
  SELECT p_partkey, ids, unnest(range(1, len(ids) + 1)) AS i FROM (
    SELECT p_partkey, json_extract_string(payload, '$.data[*].id') AS ids FROM ({_LISTINGS_SQL})))
"""


@query("catalog_ids", _IDS_SQL)
def q_catalog_ids(spark, sf_dir):
    return C.model_ids(_listings(spark, sf_dir), keys=["p_partkey"])


@query("catalog_prefix", f"SELECT * FROM ({_IDS_SQL}) WHERE starts_with(id, 'brand-1')")
def q_catalog_prefix(spark, sf_dir):
    return C.with_prefix(C.model_ids(_listings(spark, sf_dir), keys=["p_partkey"]), "brand-1")
