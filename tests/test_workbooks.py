"""Workbooks and vector files through their file system: odd characters, several headers, dates, full sheets."""

from __future__ import annotations

import datetime
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptframe.session import scratch_path, ship_package
from promptframe.sources import npy, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _book(path, sheet, styles=None, shared=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{sheet}</sheetData></worksheet>")
        if styles:
            z.writestr("xl/styles.xml", styles)
        if shared:
            z.writestr("xl/sharedStrings.xml", shared)


def _text(ref, v):
    return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'


def test_odd_characters_come_back(spark):
    ship_package(spark)
    xlsx.register(spark)
    values = ["a\r\nb", "tab\tand\nline", "bell\x07 nul\x00 esc\x1b", "_x000D_ as text", "__x0041_", "<&>\"'", "  kept  ", "", None,
              "￾￿", "𝄞 emoji 😀", "_x12", "_xZZZZ_"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    path = scratch_path(spark, "t-odd")
    df.write.format("xlsx").mode("overwrite").save(path)
    got = {int(r["i"]): r["v"] for r in spark.read.format("xlsx").load(path).collect()}
    assert got == dict(enumerate(values))


def test_sheets_roll_over_and_numbers_are_exact(spark):
    ship_package(spark)
    xlsx.register(spark)
    path = scratch_path(spark, "t-roll")
    df = spark.range(0, 25, numPartitions=2).select((F.col("id") + 9007199254740993).alias("n"),
                                                    F.when(F.col("id") == 3, float("nan")).when(F.col("id") == 4, float("inf"))
                                                    .otherwise(F.col("id") / 8).alias("x"))
    df.write.format("xlsx").option("sheetRows", 6).mode("overwrite").save(path)
    assert len([f for f in os.listdir(path.replace("file:", "")) if f.endswith(".xlsx")]) == 6
    got = {r["n"]: r["x"] for r in spark.read.format("xlsx").load(path).collect()}
    want = {str(i + 9007199254740993): i / 8 for i in range(25)}
    assert set(got) == set(want)
    assert got["9007199254740996"] is None and got["9007199254740997"] == "inf"
    assert all(float(got[k]) == v for k, v in want.items() if k[-2:] not in ("96", "97"))


def test_columns_go_by_each_workbooks_header(spark):
    root = scratch_path(spark, "t-heads").replace("file:", "")
    _book(f"{root}/a.xlsx", f'<row r="1">{_text("A1", "id")}{_text("B1", "q")}</row>'
                            f'<row r="2"><c r="A2"><v>1</v></c>{_text("B2", "one")}</row>')
    _book(f"{root}/b.xlsx", f'<row r="1">{_text("A1", "q")}{_text("B1", "x")}{_text("C1", "id")}{_text("D1", "x")}</row>'
                            f'<row r="2">{_text("A2", "two")}<c r="B2"><v>2.5</v></c><c r="C2"><v>2</v></c>{_text("D2", "dup")}</row>')
    _book(f"{root}/c.xlsx", "")
    for df in (xlsx.read_xlsx(spark, root), spark.read.format("xlsx").load(root)):
        assert df.columns == ["id", "q", "x", "x.1"]
        assert sorted(tuple(r) for r in df.collect()) == [("1", "one", None, None), ("2", "two", "2.5", "dup")]
    typed = xlsx.read_xlsx(spark, root, infer=True)
    assert [t for _, t in typed.dtypes] == ["bigint", "string", "double", "string"]


def test_dates_by_number_format(spark):
    styles = (f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/>'
              '<numFmt numFmtId="171" formatCode="[Red]0.00&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/>'
              '<xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="22"/><xf numFmtId="171"/><xf numFmtId="21"/></cellXfs></styleSheet>')
    head = "".join(_text(f"{c}1", n) for c, n in zip("ABCDEF", ["d", "own", "at", "num", "time", "mixed"]))
    rows = ('<row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>1</v></c><c r="C2" s="3"><v>45292.75</v></c>'
            '<c r="D2" s="4"><v>7</v></c><c r="E2" s="5"><v>0.5</v></c><c r="F2" t="b"><v>1</v></c></row>'
            '<row r="3"><c r="A3" s="1"><v>61</v></c><c r="C3" s="3"><v>45293</v></c><c r="F3"><v>4</v></c></row>')
    root = scratch_path(spark, "t-dates").replace("file:", "")
    _book(f"{root}/d.xlsx", f'<row r="1">{head}</row>{rows}', styles)
    df = xlsx.read_xlsx(spark, root, infer=True)
    assert df.dtypes == [("d", "date"), ("own", "date"), ("at", "timestamp_ntz"), ("num", "bigint"), ("time", "string"),
                         ("mixed", "string")]
    a, b = sorted(df.collect(), key=lambda r: r["d"], reverse=True)
    assert tuple(a) == (datetime.date(2024, 1, 1), datetime.date(1900, 1, 1), datetime.datetime(2024, 1, 1, 18), 7, "12:00:00", "True")
    assert tuple(b) == (datetime.date(1900, 3, 1), None, datetime.datetime(2024, 1, 2), None, None, "4")


def test_remote_paths_are_not_local_ones(spark):
    ship_package(spark)
    xlsx.register(spark)
    npy.register(spark)
    for fmt in ("xlsx", "npy"):
        with pytest.raises(Exception, match="nosuch"):
            spark.range(3).select(F.array("id").alias("vector")).write.format(fmt).mode("append").save("nosuch://h/x")
        with pytest.raises(Exception, match="nosuch"):
            spark.read.format(fmt).load("nosuch://h/x").collect()
    assert not os.path.exists("nosuch:")


def test_npy_files_of_any_order_and_size(spark):
    npy.register(spark)
    root = scratch_path(spark, "t-npy-any").replace("file:", "")
    os.makedirs(root)
    m = np.arange(60, dtype=np.float64).reshape(20, 3)
    np.save(f"{root}/a.npy", m)
    np.save(f"{root}/b.npy", np.asfortranarray(m + 100))
    np.save(f"{root}/c.npy", np.arange(4, dtype=np.int32))
    np.save(f"{root}/d.npy", np.zeros((0, 3)))
    got = spark.read.format("npy").option("rowsPerPartition", 7).load(root).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(44))
    assert [r["vector"] for r in got] == m.tolist() + (m + 100).tolist() + [[0.0], [1.0], [2.0], [3.0]]
    path = scratch_path(spark, "t-npy-roll")
    (spark.range(0, 23, numPartitions=2).select(F.array(F.col("id").cast("float")).alias("vector"))
     .write.format("npy").option("rowsPerFile", 5).mode("overwrite").save(path))
    assert len([f for f in os.listdir(path.replace("file:", "")) if f.endswith(".npy")]) == 6
    back = spark.read.format("npy").load(path).orderBy("pos").collect()
    assert [r["vector"][0] for r in back] == [float(i) for i in range(23)]
