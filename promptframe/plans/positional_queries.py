"""Positional operators over ``orders`` / ``customer`` / ``embeddings``.

Positions are ranks under an explicit unique key, so the oracle is
``row_number() OVER (ORDER BY key) - 1``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import positional as P
from ..session import table
from .registry import query

ORDER_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"

SLICE_START, SLICE_END = 1000, 9000


@query("slice_rows", f"""
SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, {ORDER_COLS} FROM orders)
WHERE pos >= {SLICE_START} AND pos < {SLICE_END}
""")
def q_slice_rows(spark, sf_dir):
    return P.slice_rows(table(spark, sf_dir, "orders"), SLICE_START, SLICE_END, order_by="o_orderkey")


def _customer_with_skip(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.when(F.col("c_acctbal") < 0, F.lit("negative balance")).alias("Skip"),
                    "c_custkey", "c_name", "c_acctbal")


@query("skip_filter", """
SELECT * FROM (SELECT CASE WHEN c_acctbal < 0 THEN 'negative balance' END AS Skip, c_custkey, c_name, c_acctbal
               FROM customer) WHERE coalesce(Skip, '') = ''
""")
def q_skip_filter(spark, sf_dir):
    return P.skip_filter(_customer_with_skip(spark, sf_dir))


@query("add_skip", "SELECT '' AS Skip, * FROM customer")
def q_add_skip(spark, sf_dir):
    return P.add_skip(table(spark, sf_dir, "customer"))


@query("add_index", """
SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS "index", * FROM customer
""")
def q_add_index(spark, sf_dir):
    return P.add_index(table(spark, sf_dir, "customer"), order_by=["c_mktsegment", "c_custkey"])


@query("project_fields", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q_project_fields(spark, sf_dir):
    return P.project_fields(table(spark, sf_dir, "orders"), " o_orderkey, o_orderstatus ,o_totalprice")


@query("batch_ids", """
SELECT pos, o_orderkey, CAST(floor(pos / 10) AS BIGINT) AS batch_id
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey FROM orders)
""")
def q_batch_ids(spark, sf_dir):
    return P.batch_ids(table(spark, sf_dir, "orders").select("o_orderkey"), 10, order_by="o_orderkey")


MERGE_START = 100


@query("merge_positional", f"""
WITH l AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p0,
                  CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE '' END AS Skip,
                  o_orderkey, o_orderstatus, o_totalprice FROM orders),
k AS (SELECT row_number() OVER (ORDER BY p0) - 1 AS pos, Skip, o_orderkey, o_orderstatus, o_totalprice
      FROM l WHERE p0 >= {MERGE_START} AND Skip = ''),
r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey, c_name FROM customer)
SELECT pos, Skip, o_orderkey, o_orderstatus, o_totalprice, c_custkey, c_name FROM k FULL OUTER JOIN r USING (pos)
""")
def q_merge_positional(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    left = o.select(F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(F.lit("")).alias("Skip"),
                    "o_orderkey", "o_orderstatus", "o_totalprice")
    right = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return P.merge_positional(left, right, MERGE_START, None, left_order="o_orderkey", right_order="c_custkey")


@query("zip_vectors", """
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id, len(embedding) AS n_dims FROM embeddings),
m AS (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS pos, vec_id AS meta_id, label FROM embeddings)
SELECT pos, vec_id, n_dims, meta_id, label FROM v JOIN m USING (pos)
""")
def q_zip_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    vectors = e.select("vec_id", "embedding")
    meta = e.select(F.col("vec_id").alias("meta_id"), "label")
    z = P.zip_positional(vectors, meta, left_order="vec_id", right_order=["label", "meta_id"])
    return z.select("pos", "vec_id", F.size("embedding").cast("long").alias("n_dims"), "meta_id", "label")


@query("row_count", "SELECT count(*) AS rows FROM orders")
def q_row_count(spark, sf_dir):
    return P.row_count(table(spark, sf_dir, "orders"))


@query("union_fill", """
SELECT c_name AS name, c_mktsegment AS segment, '' AS nation FROM customer
UNION ALL SELECT s_name, '', CAST(s_nationkey AS VARCHAR) FROM supplier
UNION ALL SELECT n_name, '', CAST(n_nationkey AS VARCHAR) FROM nation
""")
def q_union_fill(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))
    return P.union_fill(c, s, n)
