"""Row positions and everything the reference does with them.

The reference's tables are pandas frames whose RangeIndex is the row
position: slices are ``iloc[start:end]``, merges are ``concat(axis=1)``.  A
Spark table has no order, so a position is the rank of a row under an explicit
sort key (or, without a key, the frozen input order).

``with_pos`` never funnels rows through one task (a global ``row_number()``
window would).

*With a key*: Spark's range partitioning samples the key once and deals the rows out in
order; every partition is sorted and written as one file of a table in the shared
checkpoint folder.  A row's position is its file's offset plus its row index in the file, which Parquet
readers know, so no window and no second shuffle follow, and one small aggregate gives the rows of each file.
Ties and nulls are split evenly as well: after the key rows go by a digest of all their columns and
by the partition they came from, so neither a key that many rows share nor many equal rows stand in one partition.
The input is evaluated twice (sample, write) whatever is done with the result, there is no bound on
the number of partitions, and a slice reads only the files it overlaps.

*Without a key*: the input is checkpointed to the shared checkpoint folder,
which freezes partition contents and order; positions are the partition's
offset plus ``monotonically_increasing_id`` minus the partition's base.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, scratch_path

def _cols(order_by) -> list:
    if order_by is None:
        return []
    if isinstance(order_by, (str, Column)):
        return [order_by]
    return list(order_by)


def _hashable(kind: T.DataType) -> bool:
    """Whether Spark hashes values of a type (maps and variants it does not)."""
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType, T.NullType))


class _Ordered:
    """``df`` in the order of its keys as a written table, with the offset of each of its files."""

    def __init__(self, df: DataFrame, keys: list, num_partitions: int | None):
        spark = df.sparkSession
        self.fields = df.schema.fields
        own = [c for c, f in zip(df.columns, self.fields) if _hashable(f.dataType)]
        digest = F.xxhash64(*[F.col(f"`{c}`") for c in own]) if own else F.lit(0).cast("long")
        order = [F.col(f"`{k}`") if isinstance(k, str) else k for k in keys] + [F.col("__digest"), F.col("__from")]
        staged = df.withColumn("__digest", digest).withColumn("__from", F.spark_partition_id())
        staged = staged.repartitionByRange(num_partitions, *order) if num_partitions else staged.repartitionByRange(*order)
        # Parquet holds no untyped nulls and not every name: columns go by number, untyped ones as strings.
        stored = [F.col(f"`{f.name}`").cast("string" if isinstance(f.dataType, T.NullType) else f.dataType).alias(f"c{i}")
                  for i, f in enumerate(self.fields)]
        path = scratch_path(spark, "ordered")
        written = staged.sortWithinPartitions(*order).select(*stored)
        written.write.parquet(path)
        self.rows = spark.read.schema(written.schema).parquet(path)
        meta = self.rows.metadataColumn("_metadata")
        self.rows = self.rows.select("*", meta["file_name"].alias("__file"), meta["row_index"].alias("__row"))
        # One file a partition, named by the partition's number.
        counts = self.rows.groupBy("__file").count().collect()
        self.files, at = [], 0
        for name, n in sorted(counts, key=lambda r: int(re.match(r"part-(\d+)", r[0]).group(1))):
            self.files.append((name, at, n))
            at += n
        self.total = at

    def positions(self, pos_col: str, start: int = 0, end: int | None = None) -> DataFrame:
        """The rows with positions in [start, end), from the files that hold them."""
        end = self.total if end is None else end
        spark = self.rows.sparkSession
        some = [(name, at) for name, at, n in self.files if at < end and at + n > start]
        rows = self.rows
        if len(some) < len(self.files):
            rows = rows.where(F.col("__file").isin([name for name, _ in some]))
        # One row for each partition of the ordered table.
        offsets = spark.createDataFrame(some, "__name string, __at long")
        placed = rows.join(F.broadcast(offsets), F.col("__file") == F.col("__name"))
        pos = F.col("__at") + F.col("__row")
        if some and (start > some[0][1] or end < self.total):
            placed = placed.where((pos >= start) & (pos < end))
        own = [(F.lit(None) if isinstance(f.dataType, T.NullType) else F.col(f"c{i}")).alias(f.name)
               for i, f in enumerate(self.fields)]
        return placed.select(pos.alias(pos_col), *own)


def _frozen_pos(df: DataFrame, pos_col: str):
    """Positions in the input's own order, frozen by a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    staged = df.checkpoint(eager=True)
    counts = {r[0]: r[1] for r in staged.groupBy(F.spark_partition_id()).count().collect()}
    num = staged.rdd.getNumPartitions()
    offsets, total = [], 0
    for p in range(num):
        offsets.append(total)
        total += counts.get(p, 0)
    pid = F.spark_partition_id()
    base = F.shiftleft(pid.cast("long"), 33)
    offset = F.element_at(F.array(*[F.lit(o) for o in offsets]).cast("array<long>"), pid + 1) if offsets \
        else F.lit(0).cast("long")
    return staged.select((offset + F.monotonically_increasing_id() - base).alias(pos_col), "*"), total


def with_pos(df: DataFrame, order_by=None, pos_col: str = "pos", num_partitions: int | None = None,
             return_count: bool = False):
    """Add a 0-based ``pos`` column: the row's rank under ``order_by`` (columns or sort expressions).

    Rows of one key are told apart by their other columns' digest, so a repeated key gives the same positions
    again as long as its rows differ.  Without ``order_by``, positions follow the input's current order.
    Returns the DataFrame, or ``(DataFrame, row_count)`` with ``return_count``.
    """
    keys = _cols(order_by)
    if keys:
        table = _Ordered(df, keys, num_partitions)
        out, total = table.positions(pos_col), table.total
    else:
        out, total = _frozen_pos(df, pos_col)
    return (out, total) if return_count else out


def slice_bounds(total: int, start, end) -> tuple[int, int]:
    """Python slice semantics of ``[start:end]`` over ``total`` rows."""
    s, e, _ = slice(None if start is None else int(start), None if end is None else int(end)).indices(total)
    return s, max(s, e)


def slice_rows(df: DataFrame, start=None, end=None, order_by=None, pos_col: str = "pos",
               keep_pos: bool = True) -> DataFrame:
    """Rows ``[start, end)`` by position (PRJ1); an end past the last row is clamped.

    With a key only the files of the ordered table that overlap the slice are read.
    """
    keys = _cols(order_by)
    if keys:
        table = _Ordered(df, keys, None)
        out = table.positions(pos_col, *slice_bounds(table.total, start, end))
    else:
        staged, total = with_pos(df, order_by, pos_col, return_count=True)
        s, e = slice_bounds(total, start, end)
        out = staged.where((F.col(pos_col) >= s) & (F.col(pos_col) < e))
    return out if keep_pos else out.drop(pos_col)


def skip_filter(df: DataFrame, skip_col: str = "Skip", strict: bool = False) -> DataFrame:
    """Keep rows whose ``Skip`` is empty (PRJ2); all rows if there is no such column.

    Null counts as empty (an empty CSV cell reads as null); ``strict`` keeps
    only the literal ``''`` and requires the column.
    """
    if skip_col not in df.columns:
        if strict:
            raise ValueError(f"column {skip_col!r} is required")
        return df
    c = F.col(skip_col)
    return df.where(c == "" if strict else F.coalesce(c, F.lit("")) == "")


def add_skip(df: DataFrame, skip_col: str = "Skip") -> DataFrame:
    """Insert ``Skip = ''`` as the first column unless present (PRJ3)."""
    if skip_col in df.columns:
        return df
    return df.select(F.lit("").alias(skip_col), "*")


def add_index(df: DataFrame, order_by=None, index_col: str = "index") -> DataFrame:
    """Add or overwrite ``index`` = 0..n-1 (PRJ4); a new column goes first."""
    tmp = "__pos"
    staged = with_pos(df, order_by, tmp)
    if index_col in df.columns:
        return staged.select(*[F.col(tmp).alias(index_col) if c == index_col else F.col(f"`{c}`")
                               for c in df.columns])
    return staged.select(F.col(tmp).alias(index_col), *[F.col(f"`{c}`") for c in df.columns])


def project_fields(df: DataFrame, fields: str) -> DataFrame:
    """Select a comma-separated, trimmed field list such as ``"a, b ,c"`` (PRJ6)."""
    names = [f.strip() for f in fields.split(",") if f.strip()]
    return df.select(*[F.col(f"`{n}`") for n in names])


def infer_roles(df: DataFrame) -> tuple[str, str]:
    """Key and value fields of an uploaded table (PRJ7).

    Key = the first column (``id`` when there is none); values = the other
    columns joined by ``", "`` (``text`` when there are none).  Schema only:
    nothing is read.
    """
    cols = df.columns
    return (cols[0] if cols else "id"), (", ".join(cols[1:]) if len(cols) > 1 else "text")


def batch_ids(df: DataFrame, batch_size: int, order_by=None, pos_col: str = "pos",
              batch_col: str = "batch_id") -> DataFrame:
    """``batch_id = pos // batch_size`` (SRT4)."""
    if int(batch_size) < 1:
        raise ValueError("batch_size must be >= 1")
    staged = with_pos(df, order_by, pos_col)
    return staged.withColumn(batch_col, F.floor(F.col(pos_col) / F.lit(int(batch_size))).cast("long"))


def _suffixed(left_cols, right_cols, suffix):
    out = []
    taken = set(left_cols)
    for c in right_cols:
        name = c
        i = 1
        while name in taken:
            name = f"{c}{suffix}" if i == 1 else f"{c}{suffix}{i}"
            i += 1
        taken.add(name)
        out.append((c, name))
    return out


def merge_positional(left: DataFrame, right: DataFrame, start=None, end=None, left_order=None,
                     right_order=None, skip_col: str = "Skip", suffix: str = "_out",
                     pos_col: str = "pos") -> DataFrame:
    """Side-by-side merge by position (JN1, ``merge_table``).

    The left table is sliced to ``[start, end)``, filtered with the strict
    ``Skip == ''`` rule and renumbered from 0; the right table is numbered by
    its own order; both are joined full-outer on the position, so the shorter
    side is padded with nulls.  Clashing right-hand names get ``_out``.
    """
    if skip_col not in left.columns:
        raise ValueError(f"left table needs a {skip_col!r} column")
    sliced = slice_rows(left, start, end, left_order, pos_col="__p0")
    kept = skip_filter(sliced, skip_col, strict=True)
    # reset_index: renumber the kept rows by their original position.
    lpos = with_pos(kept, "__p0", pos_col).drop("__p0")
    rpos = with_pos(right, right_order, "__rp")
    mapping = _suffixed(left.columns + [pos_col], right.columns, suffix)
    rsel = rpos.select(F.col("__rp").alias(pos_col), *[F.col(f"`{a}`").alias(b) for a, b in mapping])
    joined = lpos.join(rsel, pos_col, "full_outer")
    return joined.select(pos_col, *[F.col(f"`{c}`") for c in left.columns], *[F.col(f"`{b}`") for _, b in mapping])


def zip_positional(left: DataFrame, right: DataFrame, left_order=None, right_order=None,
                   pos_col: str = "pos", suffix: str = "_r") -> DataFrame:
    """Zip two tables row by row with a count check (JN4).

    Returns the zipped table, or raises ``ValueError`` when the counts differ
    (the reference reports and writes nothing).
    """
    lpos, ln = with_pos(left, left_order, pos_col, return_count=True)
    rpos, rn = with_pos(right, right_order, "__rp", return_count=True)
    if ln != rn:
        raise ValueError("The number of vectors and metadatas should be the same")
    mapping = _suffixed(left.columns + [pos_col], right.columns, suffix)
    rsel = rpos.select(F.col("__rp").alias(pos_col), *[F.col(f"`{a}`").alias(b) for a, b in mapping])
    return lpos.join(rsel, pos_col, "inner")


def row_count(df: DataFrame) -> DataFrame:
    """``count(*)`` as a one-row table (PRJ16)."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def union_fill(*dfs: DataFrame, fill: str = "") -> DataFrame:
    """Union tables with different columns (SET1).

    Columns appear in first-seen order, missing cells are ``''``, bag
    semantics.  Cells become strings, as in the markdown tables the reference
    unions.
    """
    if not dfs:
        raise ValueError("nothing to union")
    cols: list[str] = []
    for d in dfs:
        cols += [c for c in d.columns if c not in cols]
    parts = [d.select(*[(F.col(f"`{c}`").cast("string") if c in d.columns else F.lit(None).cast("string")).alias(c)
                        for c in cols]) for d in dfs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.fillna(fill, subset=cols)
