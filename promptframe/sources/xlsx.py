"""Excel workbooks as a Spark Python data source (SRC3, SNK2).

``spark.read.format("xlsx").load(dir)`` reads every ``.xlsx`` under a directory, one partition per
workbook (a sheet has at most 1,048,576 rows), the first sheet, first row as the header.  Columns are the union of
the workbooks' headers in first-seen order, and each workbook's cells go to their names.  Values come as
text: numbers as written, dates and times (by the cell's number format) in ISO form, booleans as
``True`` / ``False``.  ``read_xlsx`` finds the columns, and their types if asked, by a Spark job over the
workbooks, for folders of many.  ``df.write.format("xlsx").save(dir)`` writes each partition as
workbooks of one sheet each, a new one whenever a sheet is full; characters that XML cannot hold, carriage
returns among them, are written in the format's ``_xHHHH_`` form and read back.  Files are opened
through the file system their path names (``sources.shared``).  The codec is
stdlib ``zipfile`` + streamed XML (no spreadsheet library is available).  Legacy ``.xls`` is not supported.
"""

from __future__ import annotations

import datetime
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .shared import list_files, open_fs, open_whole, qualified

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RNS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of one sheet, its header included.
SHEET_ROWS = 1_048_576
#: The built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47,
                50, 51, 52, 53, 54, 55, 56, 57, 58}
_UNSAFE = re.compile("[\x00-\x08\x0b-\x1f\ud800-\udfff\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_SPELLED = re.compile("_x([0-9A-Fa-f]{4})_")
_INTEGER = re.compile(r"-?[0-9]+")


def spell(text: str) -> str:
    """``text`` with what XML cannot hold as ``_xHHHH_``; an underscore that would begin such a form too."""
    return _UNSAFE.sub(lambda m: f"_x{ord(m.group()):04X}_", text)


def unspell(text: str) -> str:
    return _SPELLED.sub(lambda m: chr(int(m.group(1), 16)), text) if "_x" in text else text


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n - 1


def _string_item(item) -> str:
    """Text of a string item: its ``<t>``, or its rich-text runs; phonetic guides (``<rPh>``) are not text."""
    if item is None:
        return ""
    direct = item.find(f"{NS}t")
    if direct is not None:
        return unspell(direct.text or "")
    return unspell("".join((r.find(f"{NS}t").text or "") for r in item.findall(f"{NS}r") if r.find(f"{NS}t") is not None))


def _elements(z: zipfile.ZipFile, name: str, tag: str):
    """Every ``tag`` of a part of the workbook, one at a time; what has been read is let go."""
    with z.open(name) as f:
        root = None
        for event, el in ET.iterparse(f, ("start", "end")):
            if root is None:
                root = el
            if event == "end" and el.tag == f"{NS}{tag}":
                yield el
                el.clear()
                if el.tag != f"{NS}si":
                    for parent in root:
                        if parent.tag == f"{NS}sheetData":
                            parent.clear()
                else:
                    root.clear()


def _is_date(code: str) -> bool:
    """Whether a number format's code shows a date or time, quoted text and colour names aside."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower())
    return any(ch in plain.split(";")[0] for ch in "ymdhs") and "general" not in plain


def _date_styles(z: zipfile.ZipFile, names: set) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in names:
        return set()
    root = ET.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): _is_date(f.get("formatCode") or "") for f in root.iter(f"{NS}numFmt")}
    cells = root.find(f"{NS}cellXfs")
    out = set()
    for i, xf in enumerate(cells if cells is not None else ()):
        n = int(xf.get("numFmtId") or 0)
        if own.get(n, n in DATE_FORMATS):
            out.add(i)
    return out


def _moment(serial: float, from_1904: bool):
    """A serial number as a date, a date with a time, or (below one day) a time."""
    if serial < 0 or serial >= 2_958_466:
        return serial
    micros = round(serial * 86_400_000_000)
    if micros < 86_400_000_000 and not from_1904:
        return (datetime.datetime.min + datetime.timedelta(microseconds=micros)).time()
    # The 1900 calendar counts a 29 February 1900 that never was: days before March 1900 are one off.
    origin = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 31 if serial < 60 else 30)
    at = origin + datetime.timedelta(microseconds=micros)
    return at if micros % 86_400_000_000 else at.date()


def iter_rows(path: str):
    """Rows of the first sheet as lists of str / int / float / bool / date / datetime / time / None."""
    fs, inner = open_fs(path)
    with fs.open_input_file(inner) as raw, zipfile.ZipFile(raw) as z:
        names = set(z.namelist())
        shared = [_string_item(si) for si in _elements(z, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        sheet, from_1904 = "xl/worksheets/sheet1.xml", False
        if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
            wb = ET.fromstring(z.read("xl/workbook.xml"))
            props = wb.find(f"{NS}workbookPr")
            from_1904 = props is not None and props.get("date1904") in ("1", "true")
            first = next(wb.iter(f"{NS}sheet"), None)
            rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            if first is not None:
                rid = first.get(f"{RNS}id")
                for rel in rels:
                    if rel.get("Id") == rid:
                        target = rel.get("Target").lstrip("/")
                        sheet = target if target.startswith("xl/") else "xl/" + target
        dates = _date_styles(z, names)
        last_row = 0
        for row in _elements(z, sheet, "row"):
            # Rows missing between data rows are blank rows (pandas keeps them);
            # reading starts at the first populated row, as openpyxl does.
            number = int(row.get("r")) if row.get("r") else last_row + 1
            for _ in range(last_row + 1 if last_row else number, number):
                yield []
            last_row = number
            cells, idx = {}, -1
            for c in row.iter(f"{NS}c"):
                # A cell may omit its reference; it then follows the previous one.
                idx = _col_index(c.get("r")) if c.get("r") else idx + 1
                cells[idx] = _value(c, shared, dates, from_1904)
            width = max(cells) + 1 if cells else 0
            yield [cells.get(i) for i in range(width)]


def _value(c, shared: list, dates: set, from_1904: bool):
    t, v = c.get("t", "n"), c.find(f"{NS}v")
    if t == "inlineStr":
        return _string_item(c.find(f"{NS}is"))
    if v is None or v.text is None:
        return None
    if t == "s":
        return shared[int(v.text)]
    if t in ("str", "e"):
        return unspell(v.text)
    if t == "b":
        return v.text == "1"
    if t == "d":
        return v.text
    if int(c.get("s") or 0) in dates:
        return _moment(float(v.text), from_1904)
    return int(v.text) if _INTEGER.fullmatch(v.text) else float(v.text)


def _cell_text(v):
    if v is None:
        return None
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def header_names(header: list) -> list[str]:
    """Names of a header's columns: ``_c<i>`` where blank, a repeated name followed by its number."""
    out: list[str] = []
    for i, h in enumerate(header):
        name, n = _cell_text(h) or f"_c{i}", 0
        while (name if not n else f"{name}.{n}") in out:
            n += 1
        out.append(name if not n else f"{name}.{n}")
    return out


_KINDS = {str: "string", int: "bigint", float: "double", bool: "boolean", datetime.date: "date",
          datetime.datetime: "timestamp_ntz", datetime.time: "string"}


def sheet_columns(path: str, kinds: bool) -> list[tuple[str, int, str | None]]:
    """(name, place, kind of a value) of the first sheet's columns, a row for every kind met."""
    rows = iter_rows(path)
    names = header_names(next(rows, []))
    found = {(n, i, None) for i, n in enumerate(names)}
    if kinds:
        for r in rows:
            found |= {(n, i, _KINDS[type(v)]) for i, (n, v) in enumerate(zip(names, r)) if v is not None}
    return sorted(found, key=lambda f: (f[1], f[2] or ""))


def _merged(kinds: list[str]) -> str:
    """The type that holds all kinds of a column's cells."""
    met = set(kinds)
    for wide, narrow in (("double", {"bigint"}), ("timestamp_ntz", {"date"})):
        if wide in met and met <= {wide, *narrow}:
            return wide
    return met.pop() if len(met) == 1 else "string"


def read_xlsx(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """All workbooks under ``path``; their columns come from a Spark job, one task for several workbooks.

    ``infer`` types a column by the kinds of all its cells (whole numbers bigint, numbers double, dates,
    booleans; mixed kinds string).  Columns are in order of the first workbook that has them, then of their place.
    """
    import pyarrow as pa

    from ..session import ship_package

    ship_package(spark)
    register(spark)
    root = qualified(spark, path)
    files = list_files(root, ".xlsx")
    if not files:
        raise FileNotFoundError(path)

    def columns(batches):
        for b in batches:
            rows = [(n, f, i, k) for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                    for n, i, k in sheet_columns(p, infer)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_pydict({"name": pa.array(cols[0], pa.string()), "file": pa.array(cols[1], pa.int64()),
                                              "place": pa.array(cols[2], pa.int64()), "kind": pa.array(cols[3], pa.string())})

    parts = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame(list(enumerate(files)), "file long, path string").repartition(parts)
    found = (listed.mapInArrow(columns, "name string, file long, place long, kind string").groupBy("name")
             .agg(F.min(F.struct("file", "place")).alias("at"), F.collect_set("kind").alias("kinds"))
             .orderBy("at").collect())       # one row for each column name
    text = ", ".join(f"`{r['name'].replace('`', '``')}` string" for r in found)
    df = spark.read.format("xlsx").schema(text).load(root) if found else spark.read.format("xlsx").load(root)
    if not infer:
        return df
    return df.select(*[F.col(f"`{r['name'].replace('`', '``')}`").cast(_merged(r["kinds"])).alias(r["name"]) for r in found])


class _Partition(InputPartition):
    def __init__(self, path):
        super().__init__(path)
        self.path = path


class XlsxReader(DataSourceReader):
    def __init__(self, path, schema):
        self.path, self.schema = path, schema

    def partitions(self):
        return [_Partition(p) for p in list_files(self.path, ".xlsx")]

    def read(self, partition):
        rows = iter_rows(partition.path)
        place = {n: i for i, n in enumerate(header_names(next(rows, [])))}
        at = [place.get(f.name) for f in self.schema.fields]
        for r in rows:
            yield tuple(_cell_text(r[i]) if i is not None and i < len(r) else None for i in at)


def _xml_cell(ref: str, v) -> str:
    if v is None or v != v:     # a number that is none
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and abs(v) != float("inf"):
        return f'<c r="{ref}"><v>{repr(float(v)) if isinstance(v, float) else v}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(spell(str(v)))}</t></is></c>'


def _col_name(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def write_workbook(path: str, header: list[str], rows, sheet_name: str = "sheet1") -> int:
    """Write one workbook, which appears when it is whole; returns the number of data rows."""
    n = 0
    with open_whole(path) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                   '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.'
                   'spreadsheetml.sheet.main+xml"/>'
                   '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-'
                   'officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels",
                   '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
                   'relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml",
                   '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                   '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
                   'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
                   f'<sheets><sheet name="{escape(sheet_name)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/'
                   'relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                    b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            f.write(('<row r="1">' + "".join(_xml_cell(f"{_col_name(i)}1", h) for i, h in enumerate(header))
                     + "</row>").encode("utf-8"))
            letters = [_col_name(i) for i in range(len(header))]
            for r in rows:
                n += 1
                rn = n + 1
                f.write((f'<row r="{rn}">' + "".join(_xml_cell(f"{c}{rn}", v) for c, v in zip(letters, r))
                         + "</row>").encode("utf-8"))
            f.write(b"</sheetData></worksheet>")
    return n


class _Commit(WriterCommitMessage):
    def __init__(self, paths, rows):
        self.paths, self.rows = paths, rows


class XlsxWriter(DataSourceWriter):
    """``part-<write>-<partition>-<n>.xlsx`` of each non-empty partition, at most ``sheet_rows`` rows each (see ``npy.NpyWriter``)."""

    def __init__(self, path, schema, sheet_name, overwrite, sheet_rows=SHEET_ROWS):
        from .npy import write_id

        if not 2 <= sheet_rows <= SHEET_ROWS:
            raise ValueError(f"sheetRows must be from 2 to {SHEET_ROWS}")
        self.path, self.schema, self.sheet_name, self.overwrite = path.rstrip("/"), schema, sheet_name, overwrite
        self.sheet_rows, self.write_id = sheet_rows, write_id()
        open_fs(path)

    def write(self, iterator):
        from itertools import chain, islice

        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        header = [f.name for f in self.schema.fields]
        rows, paths, n = (tuple(r) for r in iterator), [], 0
        for first in rows:
            paths.append(f"{self.path}/part-{self.write_id}-{pid:05d}-{len(paths):04d}.xlsx")
            n += write_workbook(paths[-1], header, chain([first], islice(rows, self.sheet_rows - 2)), self.sheet_name)
        return _Commit(paths, n)

    def commit(self, messages):
        from .npy import remove_stale_parts

        if self.overwrite:
            remove_stale_parts(self.path, {p for m in messages if m is not None for p in m.paths}, ".xlsx")


class XlsxDataSource(DataSource):
    """``format("xlsx")``; options: ``path``, ``sheetName`` and ``sheetRows`` (write)."""

    @classmethod
    def name(cls):
        return "xlsx"

    def schema(self):
        files = list_files(self.options["path"], ".xlsx")
        if not files:
            raise FileNotFoundError(self.options["path"])
        names = dict.fromkeys(n for f in files for n, _, _ in sheet_columns(f, kinds=False))
        return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)

    def reader(self, schema):
        return XlsxReader(self.options["path"], schema)

    def writer(self, schema, overwrite):
        return XlsxWriter(self.options["path"], schema, self.options.get("sheetName", "sheet1"), overwrite,
                          int(self.options.get("sheetRows", SHEET_ROWS)))


def register(spark) -> None:
    spark.dataSource.register(XlsxDataSource)
