"""CSV in detected encodings (SRC1, SRC2, SNK1, SRC5).

``read_csv`` is Spark's reader (``multiLine``, as model outputs hold newlines: one file is one task).
``read_csv_detected`` first decides every file's character set (``charset``) and reads all of them in ranges
(``csv_ranges``), so one large file is many tasks and every file's columns go by its own header; files in UTF-16, whose
line feeds are no single bytes, go through Spark's reader.  Spark 4 accepts GBK only with
``spark.sql.legacy.javaCharsets=true``, which is set here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .charset import charsets
from .csv_ranges import read_csv_ranges

# Cells keep their leading and trailing white space and line breaks in both directions.  An empty
# cell reads as null, written from an empty string or a null alike.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}


def _enable_charsets(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def detect_encodings(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """``path, encoding`` per file, decided over every byte (see ``charset``).

    Zero-byte files are skipped by Spark's file listing (they hold no rows; the reference detects no encoding).
    """
    return charsets(spark, path, glob)


def read_csv(spark: SparkSession, path, schema=None, encoding: str | None = None, infer: bool = False,
             **options) -> DataFrame:
    """CSV with header, quoted multi-line cells and an optional encoding.

    Give a ``schema`` at scale (``infer=True`` costs a pass over the data).
    """
    _enable_charsets(spark)
    r = spark.read.options(**CSV_OPTIONS).options(**options)
    if encoding:
        r = r.option("encoding", encoding)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", "true")
    return r.csv(path)


def read_csv_detected(spark: SparkSession, path: str, schema=None, glob: str = "*.csv",
                      with_encoding: bool = True) -> DataFrame:
    """Read every CSV under ``path`` in its detected encoding, columns by each file's header (SRC1 + SRC2).

    ``schema`` (a DDL string or a type) names and types the columns; without one all are strings.
    """
    found = detect_encodings(spark, path, glob).collect()   # one row per file, not per record
    if not found:
        raise FileNotFoundError(f"no files matching {glob!r} under {path}")
    wide = [r["path"] for r in found if r["encoding"].startswith("utf-16")]
    plain = {r["path"]: r["encoding"] for r in found if r["path"] not in wide}
    parts = []
    if plain:
        got = read_csv_ranges(spark, sorted(plain), {p: e for p, e in plain.items() if e != "utf-8"}, with_file=True)
        if got.columns:
            sets = spark.createDataFrame(sorted(plain.items()), "__path string, encoding string")
            # One row a file, already on the driver: a join by file would bring each file's records together in one task.
            parts.append(got.join(F.broadcast(sets), F.col("__file") == F.col("__path")).drop("__file", "__path"))
    for r in found:
        if r["path"] in wide:
            parts.append(read_csv(spark, r["path"], encoding=r["encoding"].upper()).withColumn("encoding", F.lit(r["encoding"])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if schema is not None:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        out = out.select(*[(F.col(f"`{f.name}`") if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in fields], "encoding")
    return out if with_encoding else out.drop("encoding")


def write_csv(df: DataFrame, path: str, encoding: str = "utf-8", mode: str = "overwrite") -> str:
    """CSV with header, no index (SNK1); one file per partition."""
    _enable_charsets(df.sparkSession)
    df.write.mode(mode).options(**CSV_OPTIONS).option("encoding", encoding).csv(path)
    return path


def read_embedded_csv(spark: SparkSession, path, vector_col: str | None = None, schema=None) -> DataFrame:
    """CSV whose first (or ``vector_col``) column holds ``"[x, y, ...]"`` (SRC5)."""
    df = read_csv(spark, path, schema=schema)
    c = vector_col or df.columns[0]
    return df.withColumn(c, F.from_json(F.col(f"`{c}`"), "array<double>"))
