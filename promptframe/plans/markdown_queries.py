"""Markdown-table queries.

``md_parse`` renders every order as a small markdown table (three layouts
chosen by order status: standard; prose after the table; ``|:---|``
separator and a header without a closing pipe) and parses it back.
``md_parse_raw`` parses the documents as they are.  ``md_history`` treats a
customer's orders as one chat history whose tables have different headers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PY_WHITESPACE
from ..operators.markdown import markdown_cells, markdown_history, table_from_chat
from ..session import table
from .registry import query

_WS = PY_WHITESPACE


def _dstrip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+\\z', '', 'g')"


def _dcells(line: str) -> str:
    parts = f"string_split({line}, '|')"
    return f"list_transform(list_slice({parts}, 2, len({parts}) - 1), lambda c: {_dstrip('c')})"


def duck_parse(src: str, keys: list[str]) -> str:
    """DuckDB SQL giving ``keys.., row_no, col_no, col_name, cell`` for ``src(keys.., text)``."""
    k = ", ".join(keys)
    sep = (f"starts_with({_dstrip('l')}, '|---') OR starts_with({_dstrip('l')}, '| ---')")
    return f"""
WITH src AS ({src}),
t AS (SELECT {k}, string_split(substr(text, instr(text, '| ')), chr(10)) AS lines
      FROM src WHERE instr(text, '| ') > 0),
h AS (SELECT {k}, {_dcells('lines[1]')} AS header,
             list_filter(list_slice(lines, 2, len(lines)), lambda l: NOT ({sep})) AS body FROM t),
r AS (SELECT {k}, header, unnest(body) AS line, generate_subscripts(body, 1) - 1 AS row_no FROM h),
c AS (SELECT {k}, header, row_no, {_dcells('line')} AS cells FROM r),
x AS (SELECT {k}, header, row_no, cells, unnest(range(1, len(header) + 1)) AS i FROM c)
SELECT {k}, row_no, i - 1 AS col_no, header[i] AS col_name, coalesce(cells[i], '') AS cell FROM x
"""


def _orders_markdown(o):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    row = F.concat(F.lit("| "), key, F.lit(" | "), cust, F.lit(" | "), st, F.lit(" | "), pr, F.lit(" |"))
    std = F.concat(F.lit("Order "), key, F.lit(":\n| key | customer | status | priority |\n|---|---|---|---|\n"), row)
    prose = F.concat(std, F.lit("\nTotal shown above."))
    odd = F.concat(F.lit("Order "), key, F.lit(" | summary\n| key | customer | status | priority\n"
                                               "|:---|:---|:---|:---|\n"), row)
    return o.select("o_orderkey", F.when(st == "O", std).when(st == "F", prose).otherwise(odd).alias("text"))


_ORDERS_MD_SQL = """
SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'O' THEN 'Order ' || o_orderkey || ':' || chr(10) || '| key | customer | status | priority |'
         || chr(10) || '|---|---|---|---|' || chr(10) || rw
       WHEN o_orderstatus = 'F' THEN 'Order ' || o_orderkey || ':' || chr(10) || '| key | customer | status | priority |'
         || chr(10) || '|---|---|---|---|' || chr(10) || rw || chr(10) || 'Total shown above.'
       ELSE 'Order ' || o_orderkey || ' | summary' || chr(10) || '| key | customer | status | priority' || chr(10)
         || '|:---|:---|:---|:---|' || chr(10) || rw END AS text
FROM (SELECT *, '| ' || o_orderkey || ' | ' || o_custkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |'
      AS rw FROM orders)
"""


@query("md_parse", duck_parse(_ORDERS_MD_SQL, ["o_orderkey"]))
def q_md_parse(spark, sf_dir):
    return markdown_cells(_orders_markdown(table(spark, sf_dir, "orders")), ["o_orderkey"])


@query("md_parse_raw", duck_parse("SELECT doc_id, text FROM documents", ["doc_id"]))
def q_md_parse_raw(spark, sf_dir):
    return markdown_cells(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def _history_turns(o):
    key, st, pr = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority")
    d = F.substring(F.col("o_orderdate").cast("string"), 1, 10)   # time-zone free for timestamp_ntz
    t_o = F.concat(F.lit("| key | status | priority |\n|---|---|---|\n| "), key, F.lit(" | "), st, F.lit(" | "), pr,
                   F.lit(" |"))
    t_f = F.concat(F.lit("| key | date | status |\n| --- | --- | --- |\n| "), key, F.lit(" | "), d, F.lit(" | "), st,
                   F.lit(" |"))
    t_p = F.concat(F.lit("Here you go:\n| priority | key | date |\n|---|---|---|\n| "), pr, F.lit(" | "), key,
                   F.lit(" | "), d, F.lit(" |\n"))
    return o.select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn"),
                    F.when(st == "O", t_o).when(st == "F", t_f).otherwise(t_p).alias("text"))


_HISTORY_SRC = """
SELECT o_custkey AS conv_id, o_orderkey AS turn,
  CASE WHEN o_orderstatus = 'O' THEN '| key | status | priority |' || chr(10) || '|---|---|---|' || chr(10)
         || '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |'
       WHEN o_orderstatus = 'F' THEN '| key | date | status |' || chr(10) || '| --- | --- | --- |' || chr(10)
         || '| ' || o_orderkey || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | ' || o_orderstatus || ' |'
       ELSE 'Here you go:' || chr(10) || '| priority | key | date |' || chr(10) || '|---|---|---|' || chr(10)
         || '| ' || o_orderpriority || ' | ' || o_orderkey || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' |'
         || chr(10) END AS text
FROM orders
"""

_HISTORY_SQL = f"""
WITH cells AS ({duck_parse(_HISTORY_SRC, ["conv_id", "turn"])}),
first_seen AS (SELECT conv_id, col_name, min(turn * 1000 + col_no) AS f FROM cells GROUP BY ALL),
cols AS (SELECT conv_id, col_name, row_number() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS col_no FROM first_seen),
rows_ AS (SELECT DISTINCT conv_id, turn, row_no FROM cells)
SELECT r.conv_id, r.turn, r.row_no, c.col_no, c.col_name, coalesce(x.cell, '') AS cell
FROM rows_ r JOIN cols c ON r.conv_id = c.conv_id
LEFT JOIN cells x ON x.conv_id = r.conv_id AND x.turn = r.turn AND x.row_no = r.row_no AND x.col_name = c.col_name
"""


@query("md_history", _HISTORY_SQL)
def q_md_history(spark, sf_dir):
    return markdown_history(_history_turns(table(spark, sf_dir, "orders")))


@query("md_last_table", duck_parse("""
SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id
""", ["conv_id"]).replace("SELECT conv_id, row_no, i - 1", "SELECT '' AS Skip, conv_id, row_no, i - 1", 1))
def q_md_last_table(spark, sf_dir):
    return table_from_chat(table(spark, sf_dir, "conversations"), "Markdown Table")


@query("md_last_table_orders", duck_parse(f"""
SELECT conv_id, arg_max(text, turn) AS text FROM ({_HISTORY_SRC}) GROUP BY conv_id
""", ["conv_id"]).replace("SELECT conv_id, row_no, i - 1", "SELECT '' AS Skip, conv_id, row_no, i - 1", 1))
def q_md_last_table_orders(spark, sf_dir):
    """Extractor ``Markdown Table`` on histories whose last turn always holds a table."""
    return table_from_chat(_history_turns(table(spark, sf_dir, "orders")).withColumn("role", F.lit("assistant")),
                           "Markdown Table")
