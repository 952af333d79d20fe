"""Source / sink round trips: Spark writes a table, reads it back.

Files go below the shared checkpoint folder (``scratch_path``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chat import chat_pairs
from ..session import scratch_path, ship_package, table
from ..sources import npy, xlsx
from ..sources.csv import read_csv, read_csv_detected, write_csv
from ..sources.csv_ranges import read_csv_ranges
from ..sources.dump import dump
from .registry import query

CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
                  "c_mktsegment": "string"}


def _typed(df, types):
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


@query("src_csv_roundtrip", "SELECT * FROM customer")
def q_src_csv_roundtrip(spark, sf_dir):
    path = write_csv(table(spark, sf_dir, "customer"), scratch_path(spark, "csv-customer"))
    return _typed(read_csv(spark, path, infer=True), CUSTOMER_TYPES)


@query("snk_csv", "SELECT * FROM conversations")
def q_snk_csv(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    path = write_csv(conv, scratch_path(spark, "csv-conversations"))
    return read_csv(spark, path, schema=conv.schema)


@query("src_detect_encoding", """
SELECT c_custkey AS key, '关于 客户 ' || c_custkey || '，详见链接' AS text, 'gbk' AS encoding FROM customer
UNION ALL SELECT c_custkey, c_name || ' / ' || c_mktsegment, 'utf-8' FROM customer
""")
def q_src_detect_encoding(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    root = scratch_path(spark, "csv-encodings")
    zh = c.select(F.col("c_custkey").alias("key"),
                  F.concat(F.lit("关于 客户 "), F.col("c_custkey").cast("string"), F.lit("，详见链接")).alias("text"))
    en = c.select(F.col("c_custkey").alias("key"),
                  F.concat(F.col("c_name"), F.lit(" / "), F.col("c_mktsegment")).alias("text"))
    write_csv(zh, f"{root}/zh", encoding="gbk")
    write_csv(en, f"{root}/en", encoding="utf-8")
    return read_csv_detected(spark, root, schema="key bigint, text string")


@query("src_csv_ranges", "SELECT conv_id, turn, role, text || chr(10) || '\"' || role || '\", said' AS text FROM conversations")
def q_src_csv_ranges(spark, sf_dir):
    """Turns with line breaks, quotes and commas in their cells, read back in ranges."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(
        "text", F.lit('\n"'), "role", F.lit('", said')).alias("text"))
    path = write_csv(conv.coalesce(1), scratch_path(spark, "csv-ranges"))
    return _typed(read_csv_ranges(spark, path, glob="*.csv"), {"conv_id": "bigint", "turn": "bigint", "role": "string",
                                                               "text": "string"})


#: Everyday sentences; a character set is decided by which of its rows a file's characters lie in.
SENTENCES = {"gbk": "我们在这里讨论如何处理客户的问题", "big5": "我們在這裡討論如何處理客戶的問題",
             "shift_jis": "お客様からのご質問にお答えするために", "utf-8": "préféré – naïve"}


@query("src_charsets", " UNION ALL ".join(
    f"SELECT c_custkey AS key, '{text} ' || c_name AS text, '{name}' AS encoding FROM customer"
    for name, text in SENTENCES.items()))
def q_src_charsets(spark, sf_dir):
    """One folder with files in four character sets, each read in the set that was found for it."""
    c = table(spark, sf_dir, "customer")
    root = scratch_path(spark, "csv-charsets")
    for name, text in SENTENCES.items():
        said = c.select(F.col("c_custkey").alias("key"), F.concat(F.lit(f"{text} "), "c_name").alias("text"))
        write_csv(said, f"{root}/{name}", encoding=name)
    return read_csv_detected(spark, root, schema="key bigint, text string")


@query("src_xlsx", "SELECT * FROM customer")
def q_src_xlsx(spark, sf_dir):
    ship_package(spark)
    xlsx.register(spark)
    path = scratch_path(spark, "xlsx-customer")
    table(spark, sf_dir, "customer").write.format("xlsx").mode("overwrite").save(path)
    return _typed(spark.read.format("xlsx").load(path), CUSTOMER_TYPES)


@query("src_xlsx_headers", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 2 = 1 THEN c_acctbal END AS c_acctbal,
       c_name || chr(13) || chr(10) || chr(7) || '_x0041_' AS note
FROM customer
""")
def q_src_xlsx_headers(spark, sf_dir):
    """Workbooks with other columns in another order (SRC3), full sheets and characters that XML cannot hold (SNK2)."""
    ship_package(spark)
    xlsx.register(spark)
    path = scratch_path(spark, "xlsx-headers")
    note = F.concat("c_name", F.lit("\r\n\x07_x0041_")).alias("note")
    c = table(spark, sf_dir, "customer")
    out = {"even": c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", note),
           "odd": c.where("c_custkey % 2 = 1").select(note, "c_acctbal", "c_custkey")}
    for name, rows in out.items():
        rows.write.format("xlsx").option("sheetRows", 500).mode("overwrite").save(f"{path}/{name}")
    got = xlsx.read_xlsx(spark, path, infer=True)
    return got.select("c_custkey", "c_name", "c_acctbal", "note")


@query("src_vectors", """
SELECT pos, CAST(i - 1 AS INTEGER) AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, embedding, unnest(range(1, len(embedding) + 1)) AS i
  FROM embeddings)
""")
def q_src_vectors(spark, sf_dir):
    ship_package(spark)
    npy.register(spark)
    path = scratch_path(spark, "npy-embeddings")
    e = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding")
    e.write.format("npy").option("column", "embedding").mode("overwrite").save(path)
    back = spark.read.format("npy").option("rowsPerPartition", 128).load(path)
    return back.select("pos", F.posexplode("vector").alias("i", "x")).select(
        "pos", F.col("i").cast("int").alias("i"), F.col("x").cast("double").alias("x"))


_PAIRS = """
SELECT u.conv_id, u.turn, u.text AS Input, a.text AS Output
FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user') u
LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a USING (conv_id, turn)
"""


@query("snk_multi", f"""
SELECT *, 'csv' AS format FROM ({_PAIRS}) UNION ALL SELECT *, 'xlsx' AS format FROM ({_PAIRS})
""")
def q_snk_multi(spark, sf_dir):
    pairs = chat_pairs(table(spark, sf_dir, "conversations"))
    written = dump(pairs, scratch_path(spark, "dump-pairs"), ["csv", "xlsx", "json"]) or []
    parts = []
    for d in written:
        if d.endswith("csv"):
            back = read_csv(spark, d, schema=pairs.schema)
        else:
            back = _typed(spark.read.format("xlsx").load(d),
                          {"conv_id": "bigint", "turn": "bigint", "Input": "string", "Output": "string"})
        parts.append(back.withColumn("format", F.lit(d.rsplit("/", 1)[-1])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
