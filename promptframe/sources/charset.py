"""Which character set a text file is in (SRC2), decided over all its bytes without a value for a whole file.

Files are read as lines by Spark's text reader, which cuts large files into ranges.  In every multi-byte set
offered here a line feed is never part of a character, so a set is valid for a file just when it is for each
of its lines: tasks give partial counts (one row for a file and task), which add up.

The decision for a file: ``utf-16`` with a byte-order mark, ``utf-16-le`` / ``utf-16-be`` when many bytes are
zero, by whether those of the first line stand second or first in their pairs; ``utf-8`` when all lines are valid; else the best of GB18030 (``gbk`` where that reads
it), ``big5`` and ``shift_jis`` among those that all lines are valid in, by the share of its characters that lie
in the set's everyday rows; ``iso-8859-1`` when none is valid or everyday characters are rare.
"""

from __future__ import annotations

import collections
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Everyday characters must be this share of the characters beyond ASCII for a legacy set to be believed.
EVERYDAY = 0.5

_COUNTS = ("n_bytes", "n_lines", "nuls", "nuls_even", "nuls_odd", "marks", "bad_utf8", "bad_gbk", "bad_gb18030", "bad_big5",
           "bad_shift_jis", "n_gb18030", "day_gb18030", "n_big5", "day_big5", "n_shift_jis", "day_shift_jis")


def _gb18030(raw: bytes) -> tuple[int, int]:
    if raw[0] <= 0xA9 and len(raw) == 2 and raw[0] >= 0xA1:
        return 0, 0  # symbols
    return 1, int(len(raw) == 2 and 0xB0 <= raw[0] <= 0xD7 and raw[1] >= 0xA1)


def _big5(raw: bytes) -> tuple[int, int]:
    return (0, 0) if 0xA1 <= raw[0] <= 0xA3 else (1, int(0xA4 <= raw[0] <= 0xC6))


def _shift_jis(raw: bytes) -> tuple[int, int]:
    if raw[0] == 0x81:
        return 0, 0
    return 1, int(len(raw) == 2 and (raw[0] in (0x82, 0x83) or 0x88 <= raw[0] <= 0x97))


_ROWS = {"gb18030": _gb18030, "big5": _big5, "shift_jis": _shift_jis}


def _valid(blob: bytes, codec: str) -> str | None:
    try:
        return blob.decode(codec)
    except UnicodeDecodeError:
        return None


def count_lines(lines: list[bytes]) -> dict[str, int]:
    """The counts of some lines of one file; those of all its lines are their sums."""
    out = dict.fromkeys(_COUNTS, 0)
    blob = b"\n".join(lines)
    out["n_bytes"], out["n_lines"], out["nuls"] = len(blob), len(lines), blob.count(0)
    if blob.isascii():
        return out
    if _valid(blob, "utf-8") is None:
        out["bad_utf8"] = 1
    out["bad_gbk"] = int(_valid(blob, "gbk") is None)
    for codec, everyday in _ROWS.items():
        text = _valid(blob, codec)
        if text is None:
            out[f"bad_{codec}"] = 1
            continue
        for char, n in collections.Counter(re.sub(r"[\x00-\x7f]+", "", text)).items():
            counted, day = everyday(char.encode(codec))
            out[f"n_{codec}"] += n * counted
            out[f"day_{codec}"] += n * day
    return out


def _partial(batches):
    begun = set()
    for batch in batches:
        files, rows = collections.defaultdict(list), []
        for path, start, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
            files[path].append(line)
            if start == 0 and path not in begun:  # only at a file's head is a byte's place among the pairs known
                begun.add(path)
                rows.append({"path": path} | dict.fromkeys(_COUNTS, 0) | {
                    "nuls_even": line[::2].count(0), "nuls_odd": line[1::2].count(0),
                    "marks": int(line.startswith((b"\xff\xfe", b"\xfe\xff")))})
        for path, lines in files.items():
            rows.append({"path": path} | count_lines(lines))
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
            [("path", pa.string()), *((c, pa.int64()) for c in _COUNTS)]))


def raw_lines(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """``file, start, line``: lines as bytes with their file and the start of the range they were read in."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = reader.text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").cast("binary").alias("line"))


def _decision() -> Column:
    def share(codec):
        fits = (F.col(f"bad_{codec}") == 0) & (F.col(f"n_{codec}") > 0)
        return F.when(fits, F.col(f"day_{codec}") / F.col(f"n_{codec}")).otherwise(F.lit(-1.0))

    gb, big5, jis = share("gb18030"), share("big5"), share("shift_jis")
    best = F.greatest(gb, big5, jis)
    zeros = F.col("nuls") * 10 > F.col("n_bytes")
    return (F.when(F.col("marks") > 0, F.lit("utf-16"))
            .when(zeros & (F.col("nuls_odd") > F.col("nuls_even")), F.lit("utf-16-le"))
            .when(zeros & (F.col("nuls_even") > F.col("nuls_odd")), F.lit("utf-16-be"))
            .when(F.col("bad_utf8") == 0, F.lit("utf-8"))
            .when(best < EVERYDAY, F.lit("iso-8859-1"))
            .when(best == gb, F.when(F.col("bad_gbk") == 0, F.lit("gbk")).otherwise(F.lit("gb18030")))
            .when(best == big5, F.lit("big5")).otherwise(F.lit("shift_jis")))


def charsets(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """``path, encoding`` of every file that has a byte."""
    ship_package(spark)
    lines = raw_lines(spark, path, glob)
    parts = lines.mapInArrow(_partial, "path string, " + ", ".join(f"{c} long" for c in _COUNTS))
    sums = parts.groupBy("path").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return sums.select("path", _decision().alias("encoding"))
