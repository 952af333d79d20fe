"""CSV files read in ranges, quoted line breaks included (SRC1).

Spark's own multi-line reader takes a file in one task, because whether a line begins a record depends on all quotes
before it.  Here large files are cut into ranges of lines and the question is answered by a scan over states:

1. a quote automaton runs over every range from both states it could begin in (outside or inside a quoted cell) and gives
   where it ends: one row for a range;
2. ranges are composed in order per file.  A range either ends in one state whatever it began in, keeps its state,
   or turns it; so a range begins in the state of the last range that fixed it, turned as often as
   ranges have turned since, which a window over the small table says;
3. every range is parsed from the state it begins in; the pieces of a record that crosses ranges are brought together.

Every file's first record is its header: cells are found by name, file by file, and the result has the union of
all headers in the order of the files' paths.  Missing cells and empty ones are null, cells beyond the header are
left out, blank lines are no records, a repeated name gets ``.1``, ``.2``...
The ranges are those Spark cuts; their number is pinned in the session so that both passes see the same ones even if
executors come and go in between, and a pass that meets an unknown range fails instead of guessing.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package
from .charset import raw_lines

# A cell and what ends it, from the start of a cell; and the rest of a quoted cell up to its closing quote.
_CELL = re.compile(rb'(?:"((?:[^"]|"")*+)("?)[^,\r]*|[^",\r][^,\r]*)?(?:[,\r]|$)')
_CLOSE = re.compile(rb'(?:[^"]|"")*+"[^,\r]*(?:[,\r]|$)')


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is still open at the end of ``line``, which began inside one or not."""
    if b'"' not in line:
        return inside
    at = 0
    if inside:
        closed = _CLOSE.match(line)
        if closed is None:
            return True
        at = closed.end()
    while at <= len(line):
        cell = _CELL.match(line, at)
        if cell.group(1) is not None and not cell.group(2):
            return True
        if cell.end() == at:
            break
        at = cell.end()
    return False


def _ranges(batches):
    """((file, start), lines) of consecutive rows of one range; a range may come in several parts."""
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for key, some in itertools.groupby(zip(keys, batch.column(2).to_pylist()), key=lambda x: x[0]):
            yield key, [line for _, line in some]


def _scan(batches):
    key, state = None, [False, True]
    done = []
    for own, lines in _ranges(batches):
        if own != key:
            if key is not None:
                done.append((*key, *state))
            key, state = own, [False, True]
        for line in lines:
            if b'"' in line:
                state = [ends_inside(line, s) for s in state] if state[0] != state[1] else [ends_inside(line, state[0])] * 2
    if key is not None:
        done.append((*key, *state))
    cols = list(zip(*done)) or [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                                      pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.bool_())],
                                     ["file", "start", "from_out", "from_in"])


def begin_states(ends: DataFrame) -> DataFrame:
    """``file, start, inside``: the state each range begins in, from where ranges end (file, start, from_out, from_in)."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed, turned = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    step = ends.withColumn("__turns", F.sum(F.when(turned, 1).otherwise(0)).over(order))
    step = step.withColumn("__fixed", F.when(fixed, F.struct(F.col("from_out").alias("to"), "__turns")))
    last = F.last("__fixed", ignorenulls=True).over(before)
    past = F.coalesce(F.last("__turns").over(before), F.lit(0))
    step = step.withColumn("__last", last).withColumn("__past", past)
    since = F.col("__past") - F.coalesce(F.col("__last")["__turns"], F.lit(0))
    return step.select("file", "start", (F.coalesce(F.col("__last")["to"], F.lit(False)) != (since % 2 == 1)).alias("inside"))


def records(text: str) -> list[list[str]]:
    """Rows of whole records; blank lines are none."""
    csv.field_size_limit(sys.maxsize)
    return [row for row in csv.reader(io.StringIO(text, newline="")) if row]


def _header(cells: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for c in cells:
        n = seen.get(c, 0)
        seen[c] = n + 1
        out.append(f"{c}.{n}" if n else c)
    return out


_PARSED = pa.schema([("file", pa.string()), ("start", pa.int64()), ("head", pa.bool_()), ("cells", pa.list_(pa.string())),
                     ("fragment", pa.binary()), ("opens", pa.bool_())])


def _parse(known, inside, encodings, default):
    def run(batches):
        key, state, open_lines, first, cut = None, False, [], False, False

        def rows(lines, head):
            codec = encodings.value.get(key[0], default)
            text = b"\n".join(lines).decode(codec)
            if key[1] == 0 and head:
                text = text.removeprefix("\ufeff")
            for cells in records(text):
                yield {"file": key[0], "start": key[1], "head": head, "fragment": None, "opens": None,
                       "cells": _header(cells) if head else [c if c != "" else None for c in cells]}
                head = False

        def fragment(lines, opens):
            return {"file": key[0], "start": key[1], "head": False, "cells": None, "fragment": b"\n".join(lines), "opens": opens}

        for own, lines in _ranges(batches):
            out = []
            if own != key:
                if open_lines:
                    out.append(fragment(open_lines, not cut))
                at = np.searchsorted(known.value, hash_of(own))
                if at == len(known.value) or known.value[at] != hash_of(own):
                    raise RuntimeError(f"the ranges of {own[0]} have changed between two passes; read it again")
                key, state, open_lines, first = own, bool(inside.value[at]), [], own[1] == 0
                cut = state  # the range begins within a record
            done: list[bytes] = []
            for line in lines:
                state = ends_inside(line, state)
                open_lines.append(line)
                if not state:
                    if cut:
                        out.append(fragment(open_lines, False))
                        cut = False
                    else:
                        done += open_lines
                    open_lines = []
            if done:
                found = list(rows(done, first))
                first = first and not found
                out += found
            yield pa.RecordBatch.from_pylist(out, schema=_PARSED)
        if open_lines:
            yield pa.RecordBatch.from_pylist([fragment(open_lines, not cut)], schema=_PARSED)
    return run


def hash_of(key: tuple[str, int]) -> int:
    """A range's key as 63 bits."""
    return int.from_bytes(hashlib.blake2b(f"{key[1]}:{key[0]}".encode(), digest_size=8).digest(), "big") >> 1


def _joined(encodings, default):
    def run(batches):
        for batch in batches:
            out = []
            for path, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = b"\n".join(p["fragment"] for p in parts).decode(encodings.value.get(path, default))
                out += [{"file": path, "cells": [c if c != "" else None for c in cells]} for cells in records(text)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file", pa.string()), ("cells", pa.list_(pa.string()))]))
    return run


def read_csv_ranges(spark: SparkSession, path, encodings: dict[str, str] | None = None, default: str = "utf-8",
                    glob: str | None = None, with_file: bool = False) -> DataFrame:
    """All records of the CSV files under ``path``, strings by column name.

    ``encodings`` names the files (as Spark spells their paths) that are not in ``default``; any set
    in which a line feed, a comma and a quote are single bytes that no other character holds.
    """
    ship_package(spark)
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    lines = raw_lines(spark, path, glob)
    ends = lines.mapInArrow(_scan, "file string, start long, from_out boolean, from_in boolean")
    # 9 bytes for each range of some 128 MB.
    begins = sorted((hash_of((r[0], r[1])), r[2]) for r in begin_states(ends).collect())
    share = spark.sparkContext.broadcast
    known, inside = share(np.asarray([b[0] for b in begins], np.int64)), share(np.asarray([b[1] for b in begins], bool))
    named = share(dict(encodings or {}))
    out = scratch_path(spark, "csv-records")
    lines.mapInArrow(_parse(known, inside, named, default), "file string, start long, head boolean, cells array<string>, "
                     "fragment binary, opens boolean").write.parquet(out)
    parsed = spark.read.parquet(out)
    # A fragment that opens a record, and those up to the next one that does, are one record.
    order = Window.partitionBy("file").orderBy("start", "opens")
    split = parsed.where("fragment is not null").withColumn("__record", F.sum(F.col("opens").cast("int")).over(order))
    whole = split.groupBy("file", "__record").agg(F.sort_array(F.collect_list(F.struct("start", "opens", "fragment"))).alias("p"))
    crossed = whole.select("file", "p").mapInArrow(_joined(named, default), "file string, cells array<string>")
    heads = parsed.where("head").select("file", F.col("cells").alias("names"))
    rows = parsed.where("cells is not null and not head").select("file", "cells").union(crossed)
    kinds = heads.groupBy("names").agg(F.min("file").alias("file")).orderBy("file").collect()
    if not kinds:
        return spark.createDataFrame([], T.StructType([]))
    names = list(dict.fromkeys(n for k in kinds for n in k["names"]))
    if len(kinds) == 1:
        cells = [F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]
    else:
        rows = rows.join(F.broadcast(heads), "file")  # one row a file; a file's records stay in many tasks
        cells = [F.get("cells", (F.array_position("names", n) - 1).cast("int")).alias(n) for n in names]
    return rows.select(*([F.col("file").alias("__file")] if with_file else []), *cells)
