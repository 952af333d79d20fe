"""Sources / sinks, catalog, the driver contract and a small oracle sweep."""

from __future__ import annotations

import collections
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from promptframe.operators import catalog as C
from promptframe.session import scratch_path, ship_package
from promptframe.sources import xlsx
from promptframe.sources.csv import detect_encodings, read_csv, write_csv
from promptframe.sources.dump import dump

from .conftest import SF_SMALL, rows

PEOPLE = [("Alice", 30, "New York"), ("Bob", 25, "Paris"), ("Zoë", 35, "Zürich")]


def test_csv_and_xlsx_round_trip(spark):
    df = spark.createDataFrame(PEOPLE, "Name string, Age int, City string")
    p = write_csv(df, scratch_path(spark, "t-csv"))
    assert rows(read_csv(spark, p, infer=True)) == sorted(PEOPLE)
    ship_package(spark)
    xlsx.register(spark)
    x = scratch_path(spark, "t-xlsx")
    df.write.format("xlsx").mode("overwrite").save(x)
    back = spark.read.format("xlsx").load(x)
    assert back.columns == ["Name", "Age", "City"]
    assert rows(back.select("Name", F.col("Age").cast("int"), "City")) == sorted(PEOPLE)


def test_encoding_detection(spark):
    root = scratch_path(spark, "t-enc")
    os.makedirs(root.replace("file:", ""), exist_ok=True)
    local = root.replace("file:", "")
    with open(f"{local}/u.csv", "wb") as f:
        f.write("a,b\n1,héllo\n".encode("utf-8"))
    with open(f"{local}/g.csv", "wb") as f:
        f.write("a,b\n1,关于\n".encode("gbk"))
    with open(f"{local}/e.csv", "wb") as f:
        f.write(b"")
    got = {os.path.basename(r["path"]): r["encoding"] for r in detect_encodings(spark, root).collect()}
    # Zero-byte files hold no rows; Spark's listing skips them (no encoding).
    assert got == {"u.csv": "utf-8", "g.csv": "gbk"}


def test_encoding_detection_reads_whole_file(spark):
    root = scratch_path(spark, "t-enc-long")
    local = root.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    line = "1,hello world\n".encode("ascii")
    with open(f"{local}/late.csv", "wb") as f:          # valid UTF-8 for 2 MB, then one GBK line
        f.write(b"a,b\n" + line * ((2 << 20) // len(line)) + "2,关于\n".encode("gbk"))
    with open(f"{local}/clean.csv", "wb") as f:
        f.write(b"a,b\n" + line * ((2 << 20) // len(line)) + "2,é\n".encode("utf-8"))
    got = {os.path.basename(r["path"]): r["encoding"] for r in detect_encodings(spark, root).collect()}
    assert got == {"late.csv": "gbk", "clean.csv": "utf-8"}


def test_dump_guards(spark):
    one = spark.createDataFrame([("a",)], "x string")
    assert dump(one, scratch_path(spark, "t-d1")) is None
    assert dump(None, scratch_path(spark, "t-d0")) is None
    two = spark.createDataFrame(PEOPLE, "Name string, Age int, City string")
    assert dump(two, scratch_path(spark, "t-d2"), ["json", "xml"]) == []
    assert len(dump(two, scratch_path(spark, "t-d3"), ["csv", "xlsx"])) == 2


def test_catalog(spark):
    payload = '{"data":[{"id":"gpt-3.5-turbo"},{"id":"gpt-4"},{"id":"text-davinci-003"},{"id":"gpt-4-turbo"},{"id":"ada"}]}'
    df = spark.createDataFrame([(payload,)], "payload string")
    ids = C.model_ids(df)
    assert [r["id"] for r in ids.orderBy("idx").collect()][:2] == ["gpt-3.5-turbo", "gpt-4"]
    assert sorted(r["id"] for r in C.with_prefix(ids).collect()) == ["gpt-3.5-turbo", "gpt-4", "gpt-4-turbo"]


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


SWEEP = ["faq_fix", "chat_pairs", "slice_rows", "merge_positional", "md_parse", "md_history", "bow_counts",
         "delta_similarity", "history_retained", "history_filter", "llm_batch", "vdb_search", "embed_search",
         "label_writeback", "catalog_ids", "sample_histories", "vdb_sink", "md_last_table_orders", "bang_columns",
         "optimize_prompts", "test_prompt", "llm_call_stats", "compare_strings"]


@pytest.mark.parametrize("name", SWEEP)
def test_oracle_small(spark, name):
    from promptframe.plans import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("customer orders events documents embeddings benchmark labels conversations part").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[name](spark, SF_SMALL)
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    order = sorted(ocols)

    def norm(v):
        return round(v, 9) if isinstance(v, float) else v

    a = collections.Counter(tuple(norm(r[c]) for c in order) for r in df.collect())
    b = collections.Counter(tuple(norm(r[ocols.index(c)]) for c in order) for r in cur.fetchall())
    assert a == b


def test_xlsx_reader_shared_rich_phonetic_refless_and_gaps(spark):
    import zipfile

    from promptframe.session import ship_package
    from promptframe.sources import xlsx

    local = scratch_path(spark, "t-xlsx-foreign").replace("file:", "")
    os.makedirs(local, exist_ok=True)
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = (f'<sst {main}><si><t>name</t></si><si><t>note</t></si>'
              '<si><r><t>Ta</t></r><r><rPr/><t>ro</t></r><rPh sb="0" eb="2"><t>タロウ</t></rPh></si></sst>')
    sheet = (f'<worksheet {main}><sheetData>'
             '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c></row>'
             '<row r="3"><c r="A3" t="s"><v>2</v></c><c t="b"><v>1</v></c></row>'
             '<row r="5"><c r="B5"><v>2.5</v></c></row>'
             '</sheetData></worksheet>')
    with zipfile.ZipFile(f"{local}/foreign.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    ship_package(spark)
    xlsx.register(spark)
    df = spark.read.format("xlsx").load(local)
    assert df.columns == ["name", "note"]
    assert [tuple(r) for r in df.collect()] == [("Taro", "True"), (None, None), (None, "2.5")]


def test_detected_files_are_joined_by_broadcast(spark, tmp_path):
    """A join by file that shuffles would put all records of one file into one task."""
    from promptframe.sources.csv import read_csv_detected

    df = spark.createDataFrame([(i, f"文本 {i}") for i in range(40)], "key int, text string")
    write_csv(df, str(tmp_path / "gbk"), encoding="gbk")
    write_csv(df.withColumnRenamed("text", "other"), str(tmp_path / "utf"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = read_csv_detected(spark, str(tmp_path))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert got.count() == 80 and got.where("text is not null").count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
