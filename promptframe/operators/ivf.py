"""Inverted-file vector search, and exact search between two large tables, both by tiles.

A tile holds up to ``TILE_ROWS`` vectors of one posting list as one row: their ids and one matrix.  Search joins query
tiles with store tiles by (list, part), or brings groups of tiles together where all meet all (``_crossed``), and scores them
as one matrix product, so no row per pair of vectors exists; a product leaves at most ``k`` hits a query, and a window limited to ``k``
(planned with a limit before the shuffle) keeps the best under the total order (score descending, id ascending).

*Index* (``build_ivf``): a coarse quantiser of ``lists`` centres is fitted on a bounded, documented sample
(``SAMPLE_PER_LIST * lists`` rows with the least id hash); **every** row is then assigned to its nearest
centre and stored in that centre's list.  A list of more than ``PART_ROWS`` rows is cut into parts by a hash of the id, and
queries meet each part in a task of its own, so a list with a third of all rows is no task of its own.
*Search* (``search_ivf``): a query visits its ``nprobe`` nearest lists; hits are scored exactly.  With ``nprobe`` at
the number of lists the result is the exact one.

``knn_tiled`` is exact search without lists: the way ``knn_search`` goes when neither side can be broadcast.

Rows with a null vector take no part; vectors of unequal length are an error; an empty store or no query gives no hits.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import scratch_path, ship_package
from .spectral import matrix

TILE_ROWS = 512
PART_ROWS = 250_000
SAMPLE_PER_LIST = 64
MAX_LISTS = 4096
NPROBE = 8
TURNS = 15
#: Values of one side's vectors in one task of a search that compares all with all (32 MB).
CELL_VALUES = 4_000_000


class IvfIndex(NamedTuple):
    """``centres`` and rows by list (both bounded by ``MAX_LISTS``), and the table of tiles."""

    centres: np.ndarray
    sizes: np.ndarray
    metric: str
    tiles: DataFrame


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))
    return x / np.where(n > 0, n, 1)[:, None]


def _fit(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Centres of k-means over a sample."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), min(lists, len(x)), replace=False))]
    for _ in range(TURNS):
        near = (-2 * x @ centres.T + (centres * centres).sum(1)).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _visits(x: np.ndarray, centres: np.ndarray, nprobe: int) -> np.ndarray:
    """The ``nprobe`` nearest centres of every row, nearest first, ties to the smaller number."""
    far = (centres * centres).sum(1) - 2 * x @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :nprobe]


def _assigned(rows: DataFrame, centres: np.ndarray, metric: str, nprobe: int) -> DataFrame:
    """``list, id, vector`` of ``rows`` (id, vector): one row for each list a row visits."""
    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                x = matrix(part.column(1))
                if not len(x):
                    continue
                if x.shape[1] != centres.shape[1]:
                    raise ValueError("vectors of unequal length")
                lists = _visits(_unit(x) if metric == "cosine" else x, centres, nprobe)
                again = pa.array(np.repeat(np.arange(len(x)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), part.column(0).take(again),
                                                  part.column(1).take(again)], ["list", "id", "vector"])

    return rows.mapInArrow(run, T.StructType([T.StructField("list", T.IntegerType()), *rows.schema.fields]))


def _tiles(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``list, part, ids, matrix`` from rows (list, id, vector); ``parts`` (list, parts) cuts large lists by the id's hash."""
    if parts is None:
        rows = rows.withColumn("part", F.lit(0))
    else:
        rows = rows.join(F.broadcast(parts), "list").withColumn(
            "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    kind = rows.schema["id"].dataType

    def run(batches):
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                for first in range(low, high, TILE_ROWS):
                    some = batch.slice(first, min(TILE_ROWS, high - first))
                    x = matrix(some.column(3))
                    ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), some.column(2))
                    yield pa.RecordBatch.from_arrays([some.column(0).slice(0, 1), some.column(1).slice(0, 1), ids,
                                                      pa.array([x.tobytes()], pa.binary())], ["list", "part", "ids", "matrix"])

    schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("part", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(kind)), T.StructField("matrix", T.BinaryType())])
    # Rows of one list and part stand together, so that tiles are full.
    dealt = rows.repartition("list", "part", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("list", "part")
    return dealt.select("list", "part", "id", "vector").mapInArrow(run, schema)


def _ids(column: pa.Array, kind: T.DataType) -> np.ndarray:
    whole = isinstance(kind, T.IntegralType) and not column.null_count
    return column.to_numpy(zero_copy_only=False) if whole else np.array(column.to_pylist(), object)


def _searched(queries: DataFrame, store: DataFrame, k: int, metric: str, gamma: float, exclude_self: bool) -> DataFrame:
    """Best ``k`` of every query over pairs of query tiles and store tiles with the same (list, part)."""
    from .vectors import best_hits

    q_kind, s_kind = queries.schema["ids"].dataType.elementType, store.schema["ids"].dataType.elementType

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, s_ids = _ids(batch.column(0)[i].values, q_kind), _ids(batch.column(2)[i].values, s_kind)
                q = np.frombuffer(batch.column(1)[i].as_buffer()).reshape(len(q_ids), -1)
                s = np.frombuffer(batch.column(3)[i].as_buffer()).reshape(len(s_ids), -1)
                out = best_hits(q_ids, q, s_ids, s, k, metric, gamma, exclude_self)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], batch.column(0).type.value_type), pa.array(out[1], batch.column(2).type.value_type),
                     pa.array(out[2], pa.float64())], ["q_id", "s_id", "score"])

    # The sizes Spark guesses for rows out of Python are those of the rows that went in: neither side may be broadcast on them.
    met = (queries.select("list", "part", F.col("ids").alias("q_ids"), F.col("matrix").alias("q")).hint("merge")
           .join(store.select("list", "part", F.col("ids").alias("s_ids"), F.col("matrix").alias("s")), ["list", "part"]))
    return _ranked(met.select("q_ids", "q", "s_ids", "s").mapInArrow(run, _hit_schema(q_kind, s_kind)), k)


def _hit_schema(q_kind: T.DataType, s_kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("q_id", q_kind), T.StructField("s_id", s_kind), T.StructField("score", T.DoubleType())])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q_id").orderBy(F.col("score").desc(), F.col("s_id"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("q_id", F.col("rank").cast("int").alias("rank"), "s_id", "score"))


def _side(tiles: pa.Table, kind: T.DataType) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of all tiles of a table with the columns ``ids`` and ``matrix``."""
    ids = [_ids(v.values, kind) for v in tiles.column("ids")]
    parts = [np.frombuffer(v.as_buffer()).reshape(len(i), -1) for i, v in zip(ids, tiles.column("matrix"))]
    if len({p.shape[1] for p in parts}) > 1:
        raise ValueError("vectors of unequal length")
    return np.concatenate(ids), np.concatenate(parts)


def _crossed(queries: DataFrame, store: DataFrame, n_queries: int, n_store: int, dim: int, k: int, metric: str, gamma: float,
             exclude_self: bool) -> DataFrame:
    """Best ``k`` of every query when every query tile meets every store tile.

    Tiles of both sides are dealt into groups of about ``CELL_VALUES`` values, and a task scores one group of queries
    against one group of the store: a tile is sent once for each group of the other side (not for each tile or list),
    a task holds two groups, and a query leaves ``k`` hits for each group of the store.
    """
    from .vectors import best_hits

    q_kind, s_kind = queries.schema["ids"].dataType.elementType, store.schema["ids"].dataType.elementType
    schema = _hit_schema(q_kind, s_kind)
    rows = max(TILE_ROWS, CELL_VALUES // max(dim, 1))
    s_groups = max(1, math.ceil(n_store / rows))
    # Small inputs still give every core some groups of queries.
    cores = queries.sparkSession.sparkContext.defaultParallelism
    q_groups = max(1, math.ceil(n_queries / rows), min(math.ceil(n_queries / TILE_ROWS), math.ceil(3 * cores / s_groups)))

    def dealt(tiles, own, groups, other, others):
        group = F.pmod(F.xxhash64("ids", "matrix"), F.lit(groups)).cast("int")
        return tiles.select(group.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), "ids", "matrix")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return pa.Table.from_pylist([], to_arrow_schema(schema))
        (q_ids, q), (s_ids, s) = _side(asked, q_kind), _side(held, s_kind)
        out = best_hits(q_ids, q, s_ids, s, k, metric, gamma, exclude_self)
        return pa.Table.from_arrays([pa.array(out[0], asked.schema.field("ids").type.value_type),
                                     pa.array(out[1], held.schema.field("ids").type.value_type),
                                     pa.array(out[2], pa.float64())], names=["q_id", "s_id", "score"])

    left = dealt(queries, "qg", q_groups, "sg", s_groups).groupBy("qg", "sg")
    right = dealt(store, "sg", s_groups, "qg", q_groups).groupBy("qg", "sg")
    return _ranked(left.cogroup(right).applyInArrow(run, schema), k)


def _extent(rows: DataFrame) -> tuple[int, int]:
    """How many rows, and the longest vector."""
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    return n, dim or 0


def _given(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull())


def _parts(spark: SparkSession, sizes: np.ndarray) -> DataFrame:
    """(list, parts) of every list: at most ``MAX_LISTS`` rows."""
    return spark.createDataFrame([(i, max(1, math.ceil(n / PART_ROWS))) for i, n in enumerate(sizes.tolist())],
                                 "list int, parts int")


def build_ivf(store: DataFrame, lists: int | None = None, metric: str = "cosine", s_id: str = "id", s_vec: str = "vector",
              path: str | None = None, seed: int = 0) -> IvfIndex:
    """Index every row of ``store``; written below ``path`` (default: the shared scratch folder) for ``load_ivf``.

    ``lists`` defaults to the root of the row count, ``MAX_LISTS`` at most.  ``metric`` is ``cosine`` or ``l2``.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError("an inverted file needs the metric 'cosine' or 'l2'")
    spark = store.sparkSession
    ship_package(spark)
    path = path or scratch_path(spark, "ivf")
    rows = _given(store, s_id, s_vec)
    n = rows.count()
    lists = max(1, min(lists or math.isqrt(n), MAX_LISTS, n or 1))
    from .spectral import landmark_rows

    sample = [r["vector"] for r in landmark_rows(rows, n, SAMPLE_PER_LIST * lists)] if n else [[0.0]]
    if len({len(v) for v in sample}) > 1:
        raise ValueError("vectors of unequal length")
    x = np.asarray(sample, np.float64)
    centres = _fit(_unit(x) if metric == "cosine" else x, lists, seed)
    placed = f"{path}/placed"
    _assigned(rows, centres, metric, 1).write.parquet(placed)
    assigned = spark.read.parquet(placed)
    sizes = np.zeros(len(centres), np.int64)
    for r in assigned.groupBy("list").count().collect():
        sizes[r[0]] = r[1]
    _tiles(assigned, _parts(spark, sizes)).write.parquet(f"{path}/tiles")
    spark.createDataFrame([(i, [float(v) for v in c], int(n), metric) for i, (c, n) in enumerate(zip(centres, sizes))],
                          "list int, centre array<double>, size long, metric string").write.parquet(f"{path}/centres")
    return IvfIndex(centres, sizes, metric, spark.read.parquet(f"{path}/tiles"))


def load_ivf(spark: SparkSession, path: str) -> IvfIndex:
    """An index that ``build_ivf`` wrote."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").collect()
    return IvfIndex(np.asarray([r["centre"] for r in rows]), np.asarray([r["size"] for r in rows]), rows[0]["metric"],
                    spark.read.parquet(f"{path}/tiles"))


def search_ivf(index: IvfIndex, queries: DataFrame, k: int = 3, nprobe: int = NPROBE, q_id: str = "q_id",
               q_vec: str = "vector", exclude_self: bool = False) -> DataFrame:
    """``q_id, rank, s_id, score``: the best ``k`` of the ``nprobe`` lists nearest to each query."""
    spark = queries.sparkSession
    ship_package(spark)
    if not index.sizes.sum():  # nothing to visit
        schema = T.StructType([T.StructField("q_id", queries.schema[q_id].dataType), T.StructField("rank", T.IntegerType()),
                               T.StructField("s_id", index.tiles.schema["ids"].dataType.elementType),
                               T.StructField("score", T.DoubleType())])
        return spark.createDataFrame([], schema)
    if nprobe >= len(index.centres):
        # Every query meets every list: no copy of a query per list is needed.
        asked = _given(queries, q_id, q_vec)
        n, dim = _extent(asked)
        if n and dim != index.centres.shape[1]:
            raise ValueError("vectors of unequal length")
        parts = spark.createDataFrame([(0, max(1, math.ceil(n / PART_ROWS)))], "list int, parts int")
        return _crossed(_tiles(asked.select(F.lit(0).alias("list"), "id", "vector"), parts), index.tiles, n,
                        int(index.sizes.sum()), dim, k, index.metric, 1.0, exclude_self)
    visits = _assigned(_given(queries, q_id, q_vec), index.centres, index.metric, max(1, min(nprobe, len(index.centres))))
    tiles = _tiles(visits, None).join(F.broadcast(_parts(spark, index.sizes)), "list")
    # A query tile meets every part of its list.
    tiles = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return _searched(tiles, index.tiles, k, index.metric, 1.0, exclude_self)


def knn_tiled(queries: DataFrame, store: DataFrame, k: int = 3, q_id: str = "q_id", q_vec: str = "vector", s_id: str = "id",
              s_vec: str = "vector", metric: str = "cosine", gamma: float = 1.0, exclude_self: bool = False,
              part_rows: int = PART_ROWS) -> DataFrame:
    """Exact best ``k`` of every query, neither side broadcast: groups of tiles of both sides meet.

    A tile of the store holds at most ``part_rows`` rows.
    """
    spark = queries.sparkSession
    ship_package(spark)
    rows, asked = _given(store, s_id, s_vec), _given(queries, q_id, q_vec)
    (n, dim), (n_queries, _) = _extent(rows), _extent(asked)

    def tiles(side, count, most):
        one = spark.createDataFrame([(0, max(1, math.ceil(count / most)))], "list int, parts int")
        return _tiles(side.select(F.lit(0).alias("list"), "id", "vector"), one)

    return _crossed(tiles(asked, n_queries, PART_ROWS), tiles(rows, n, part_rows), n_queries, n, dim, k, metric, gamma,
                    exclude_self)
