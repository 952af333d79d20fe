"""Vector table and exact top-k search (VEC1-VEC7, AGG2, JS4).

A vector table is a DataFrame ``(id string, vector array<float>, text
string, metadata map<string,string>)`` kept as parquet.  Mutations are set
operations that produce the next version of the table: import = append,
upsert = anti-join + union (+ newest-per-key), delete = anti-join, clear =
empty table.

Search is exact.  Scores are computed with numpy on blocks of rows inside
``mapInPandas`` (one matrix product per Arrow batch) against the *smaller*
side, broadcast after a size check:

* queries fit the limit: broadcast the queries, stream the table; each task
  keeps its best ``k`` per query under the total order (score desc, id asc),
  and a final ``row_number() <= k`` per query sees at most ``k`` rows per task;
* else the table fits: broadcast the table, stream the queries; every task
  emits final answers, no shuffle at all;
* else: tiles of both sides meet in one lazy join (``ivf.knn_tiled``, same exact result).

Approximate search over an inverted file is in ``ivf``.

No pair set is ever materialised: rows leave a task only as top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship_package, spread

# Bytes of float64 matrix allowed in one broadcast (checked before collecting).
BROADCAST_LIMIT_BYTES = 256 << 20

STORE_SCHEMA = "id string, vector array<float>, text string, metadata map<string,string>"


def vector_records(df: DataFrame, vector_col: str, id_expr=None, text_col: str | None = None,
                   value_fields: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Rows -> vector-table records (VEC1 import shape), plus ``carry`` columns.

    ``id_expr`` defaults to md5 of the row's number and its vector: one id per
    row, also where vectors repeat, and the same one when the same table is
    imported again.
    """
    from ..functions.vectors import vector_to_text

    idc = id_expr if id_expr is not None else F.md5(F.concat_ws(
        "|", F.monotonically_increasing_id().cast("string"), vector_to_text(vector_col)))
    meta = value_fields or []
    mcol = (F.create_map(*[x for v in meta for x in (F.lit(v), F.col(f"`{v}`").cast("string"))])
            if meta else F.create_map().cast("map<string,string>"))
    txt = F.col(f"`{text_col}`").cast("string") if text_col else F.lit(None).cast("string")
    return df.select(idc.cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"),
                     txt.alias("text"), mcol.alias("metadata"), *(carry or []))


def upsert(store: DataFrame, incoming: DataFrame, overwrite: bool = True, key: str = "text",
           seq_col: str | None = None) -> DataFrame:
    """Upsert records (VEC2).

    ``overwrite``: records whose ``key`` equals an incoming key are replaced
    (incoming records with a null key are added, they match nothing);
    within the incoming batch the record with the largest ``seq_col`` per key
    wins (ties, and batches without ``seq_col``, are decided by a digest).  Without ``overwrite`` records are appended.

    Exactly one record per key comes in: ``row_number() <= 1`` with a limit in
    each task before the shuffle, so a key held by a third of the rows costs one
    row per task.
    """
    cols = ["id", "vector", "text", "metadata"]
    if not overwrite:
        return store.select(*cols).unionByName(incoming.select(*cols))
    order = F.col(seq_col).cast("long") if seq_col else F.xxhash64("id")
    # Written once: both uses below read it, so a model call or parse upstream runs once.
    checkpoint_dir(incoming.sparkSession)
    staged = incoming.select(*cols, order.alias("_o")).checkpoint()
    # One row per key, ties by id and content; planned with a limit before the shuffle (WindowGroupLimit).
    latest = Window.partitionBy(key).orderBy(F.desc_nulls_last("_o"), F.desc("id"), F.xxhash64("vector"),
                                             F.to_json("metadata"))
    newest = (staged.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(latest))
              .where("_n = 1").select(*cols))
    # A record without a key replaces nothing and is added as it is.
    unkeyed = staged.where(F.col(key).isNull()).select(*cols)
    kept = store.join(newest.select(key), key, "left_anti")
    return kept.select(*cols).unionByName(newest).unionByName(unkeyed)


def delete(store: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Delete records by id (VEC3)."""
    return store.join(ids.select(F.col(id_col).cast("string").alias("id")), "id", "left_anti")


def clear(store: DataFrame) -> DataFrame:
    """Empty the table, keeping its schema (VEC4)."""
    return store.where(F.lit(False))


def stats(store: DataFrame, namespace=None) -> DataFrame:
    """Record count and vector dimension (AGG2 / VEC7), optionally per namespace."""
    aggs = [F.count(F.lit(1)).alias("vector_count"), F.min(F.size("vector")).alias("dimension_min"),
            F.max(F.size("vector")).alias("dimension_max")]
    return store.groupBy(namespace).agg(*aggs) if namespace is not None else store.agg(*aggs)


def parse_vectors(df: DataFrame, text_col: str, out: str = "vector") -> DataFrame:
    """``"[0.1, 0.2]"`` text -> ``array<double>`` (JS4, SRC5); malformed -> null."""
    return df.withColumn(out, F.from_json(F.col(text_col), "array<double>"))


# ---------------------------------------------------------------- search


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1))
    n[n == 0] = 1.0
    return m / n[:, None]


def _score(a: np.ndarray, b: np.ndarray, metric: str, gamma: float) -> np.ndarray:
    """Scores of rows of ``a`` against rows of ``b`` (higher = closer)."""
    if metric == "cosine":
        return _unit(a) @ _unit(b).T
    if metric == "dot":
        return a @ b.T
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    d2 = np.maximum(d2, 0.0)
    if metric == "l2":
        return -np.sqrt(d2)
    if metric == "rbf":
        return np.exp(-gamma * d2)
    raise ValueError(f"unknown metric {metric!r}")


#: Columns of a score matrix whose greatest score stands for them in the first step of ``_top``.
GROUP = 32


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, column, rank`` of the best ``k`` columns of every row under (score desc, column asc); NaN comes last."""
    m, n = scores.shape
    if n <= 4 * k or np.isnan(scores).any():
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        width = order.shape[1]
        return np.repeat(np.arange(m), width), order.ravel(), np.tile(np.arange(1, width + 1), m)
    # The k-th greatest of the groups' maxima is no more than the row's k-th greatest score.
    groups = n // GROUP
    maxima = scores[:, :groups * GROUP].reshape(m, GROUP, groups).max(axis=1) if groups >= 4 * k else scores
    bound = np.partition(maxima, maxima.shape[1] - k, axis=1)[:, maxima.shape[1] - k]
    enough = scores >= bound[:, None]
    crowded = np.flatnonzero(enough.sum(axis=1) > 64 * k)
    picked = []
    for i in crowded:  # many equal scores: all greater ones, and the first of the equal ones
        kth = np.partition(scores[i], n - k)[n - k]
        above = np.flatnonzero(scores[i] > kth)
        picked.append(np.concatenate([above, np.flatnonzero(scores[i] == kth)[:k - len(above)]]))
    enough[crowded] = False
    row, col = np.nonzero(enough)
    row, col = np.concatenate([row, np.repeat(crowded, k)]), np.concatenate([col, *picked])
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    best = rank <= k
    return row[best], col[best], rank[best]


def id_order(ids: np.ndarray) -> np.ndarray:
    """Places of ids in ascending order, nulls first."""
    if ids.dtype != object:
        return np.argsort(ids, kind="stable")
    return np.array(sorted(range(len(ids)), key=lambda i: (False,) if ids[i] is None else (True, ids[i])), int)


def best_hits(q_ids, q, s_ids, s, k: int, metric: str, gamma: float, exclude_self: bool):
    """``q_ids, s_ids, scores, ranks``: the best ``k`` rows of ``s`` for each row of ``q``, in blocks of ``BLOCK_CELLS`` scores."""
    if q.shape[1] != s.shape[1]:
        raise ValueError("vectors of unequal length")
    order = id_order(s_ids)
    s_ids, s = s_ids[order], s[order]
    if metric == "cosine":  # once, not in every block
        q, s, metric = _unit(q), _unit(s), "dot"
    found: list[tuple] = []
    step = max(1, BLOCK_CELLS // max(len(s), 1))
    for first in range(0, len(q) if len(s) else 0, step):
        scores, mine = _score(q[first:first + step], s, metric, gamma), q_ids[first:first + step]
        if exclude_self:
            scores[mine[:, None] == s_ids[None, :]] = -np.inf
        row, col, rank = _top(scores, k)
        value = scores[row, col]
        some = ~np.isneginf(value)
        found.append((mine[row[some]], s_ids[col[some]], value[some], rank[some]))
    if not found:
        return q_ids[:0], s_ids[:0], np.zeros(0), np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*found))


def _collect_side(df: DataFrame, id_col: str, vec_col: str):
    """The (size-checked) broadcast side as ``ids, float64 matrix``.

    Collected as Arrow and flattened column-wise, so the driver holds the
    matrix once and never one Python object per value.
    """
    tbl = df.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")).toArrow()
    if tbl.num_rows == 0:
        return np.zeros(0, dtype=object), np.zeros((0, 0))
    col = tbl.column("i")
    numeric = pa.types.is_integer(col.type) and col.null_count == 0
    ids = col.to_numpy() if numeric else np.array(col.to_pylist(), dtype=object)
    vecs = tbl.column("v").combine_chunks()
    if vecs.null_count:
        raise ValueError(f"null vectors in {vec_col!r}")
    lengths = np.diff(vecs.offsets.to_numpy())
    if len(set(lengths.tolist())) > 1:
        raise ValueError(f"vectors in {vec_col!r} differ in length")
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, flat.reshape(len(vecs), int(lengths[0]) if len(lengths) else 0)


# Score-matrix cells per numpy product (bounds task memory to ~32 MB).
BLOCK_CELLS = 4_000_000


#: Values of the store's rows that meet the broadcast queries at a time (32 MB).
BATCH_VALUES = 4_000_000


def _stream_mapper(bc, id_col, vec_col, k, metric, gamma, exclude_self, stream_is_query, id_type):
    """Score the streamed rows against the broadcast side, in bounded blocks.

    Streamed queries: each batch against the whole table (final answers).
    Streamed table rows: batches of up to ``BATCH_VALUES`` values against all broadcast
    queries (the best ``k`` of these rows for every query).
    """
    def hits(frames, side_ids, side_mat):
        ids = np.concatenate([f[id_col].to_numpy() for f in frames])
        mat = np.stack([np.asarray(v, dtype=np.float64) for f in frames for v in f[vec_col]])
        asked = (ids, mat, side_ids, side_mat) if stream_is_query else (side_ids, side_mat, ids, mat)
        out = best_hits(*asked, k, metric, gamma, exclude_self)
        return pd.DataFrame({"q_id": pd.Series(out[0], dtype=id_type[0]),
                             "s_id": pd.Series(out[1], dtype=id_type[1]),
                             "score": pd.Series(out[2], dtype="float64"),
                             "rank": pd.Series(out[3], dtype="int32")})

    def run(batches):
        side_ids, side_mat = bc.value
        held, values = [], 0
        for pdf in batches:
            if len(pdf) == 0 or len(side_ids) == 0:
                continue
            held.append(pdf)
            values += len(pdf) * side_mat.shape[1]
            if stream_is_query or values >= BATCH_VALUES:
                yield hits(held, side_ids, side_mat)
                held, values = [], 0
        if held:
            yield hits(held, side_ids, side_mat)
    return run


def _np_dtype(t):  # an id may be null
    return "Int64" if isinstance(t, (T.LongType, T.IntegerType)) else object


def knn_search(queries: DataFrame, store: DataFrame, k: int = 3, q_id: str = "q_id", q_vec: str = "vector",
               s_id: str = "id", s_vec: str = "vector", metric: str = "cosine", gamma: float = 1.0,
               exclude_self: bool = False, broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Exact top-``k`` per query: ``q_id, rank, s_id, score`` (VEC5 / SRT3).

    Ties are broken by the store id (ascending).  ``exclude_self`` drops
    pairs with equal ids (kNN graph of a table against itself).  Rows with a
    null vector take no part; vectors of unequal length are an error.
    """
    spark = queries.sparkSession
    ship_package(spark)
    qt = queries.schema[q_id].dataType
    st = store.schema[s_id].dataType
    out_schema = T.StructType([T.StructField("q_id", qt), T.StructField("s_id", st),
                               T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    types = (_np_dtype(qt), _np_dtype(st))
    # The query side is counted, sized and collected: persist it so an
    # upstream model map (embedding the queries) runs once, not three times.
    # A row without a vector can neither ask nor be found: leave it out (the
    # filter reaches the scan) rather than fail the job on one null.
    q = queries.select(q_id, q_vec).where(F.col(q_vec).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    s = store.select(s_id, s_vec).where(F.col(s_vec).isNotNull())
    nq, dim = q.agg(F.count(F.lit(1)), F.max(F.size(q_vec))).first()
    dim = int(dim or 0)
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), F.col("s_id"))

    def finish(df):
        return (df.drop("rank").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("q_id", F.col("rank").cast("int").alias("rank"), "s_id", "score"))

    if nq * max(dim, 1) * 8 <= broadcast_limit:
        bc = spark.sparkContext.broadcast(_collect_side(q, q_id, q_vec))
        q.unpersist()
        part = spread(s).mapInPandas(_stream_mapper(bc, s_id, s_vec, k, metric, gamma, exclude_self, False, types),
                                     out_schema)
        return finish(part)
    ns = s.count()
    if ns * max(dim, 1) * 8 <= broadcast_limit:
        bc = spark.sparkContext.broadcast(_collect_side(s, s_id, s_vec))
        q.unpersist()
        part = spread(q).mapInPandas(_stream_mapper(bc, q_id, q_vec, k, metric, gamma, exclude_self, True, types), out_schema)
        # Every task holds whole queries: its ranks are final, no shuffle.
        return part.select("q_id", "rank", "s_id", "score")
    # Both sides large: tiles of both meet in one lazy join.
    q.unpersist()
    from .ivf import knn_tiled

    return knn_tiled(queries, s, k, q_id, q_vec, s_id, s_vec, metric, gamma, exclude_self,
                     max(1, broadcast_limit // (max(dim, 1) * 8)))


def with_content(hits: DataFrame, store: DataFrame, s_id: str = "id", columns: tuple[str, ...] = ("text", "metadata")) -> DataFrame:
    """Search hits with what was found: ``columns`` of the store's records (VEC5, VEC6).

    Joined on the id of the final hits, at most ``k`` rows per query; ids are taken to be
    unique in the store.  A hit whose record has a null id keeps its rank without content.
    """
    found = store.select(F.col(s_id).alias("__found"), *[F.col(f"`{c}`") for c in columns])
    return hits.join(found, F.col("s_id") == F.col("__found"), "left").drop("__found")


def hits_json(hits: DataFrame, pretty: bool = False, q_id: str = "q_id", out: str = "hits") -> DataFrame:
    """Search hits as one JSON list per query, best first (JS2).

    The list per query holds at most ``k`` hits, so the group is bounded.  Hits of
    ``with_content`` show their text and metadata too.
    ``pretty`` indents the JSON as the reference's display does.
    """
    shown = [c for c in ("text", "metadata") if c in hits.columns]
    # Sorted by rank alone: a map cannot be compared.
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("s_id").alias("id"), "score", *shown)),
                         lambda a, b: a["rank"] - b["rank"])
    opts = {"pretty": "true"} if pretty else {}
    return hits.groupBy(q_id).agg(F.to_json(items, opts).alias(out))


def import_vectors(table: DataFrame, value_fields, vectors: DataFrame, client: dict, start: int = 0,
                   end: int | None = None, batch_size: int = 100, shape: str = "records", order_by=None,
                   vec_order=None, vec_col: str = "vector") -> DataFrame:
    """The import action in one call (VEC1 + JN4 + SNK5 / SNK6).

    Rows ``[start, end)`` of ``table`` (under ``order_by``) give the value
    fields; vector ``i`` (numbered by ``vec_order``, default the ``pos`` column
    of ``format("npy")``) is paired with the slice's row ``i``.  Unequal
    counts raise ``ValueError`` and nothing is written, as in the reference.
    Records get digest ids (the reference draws uuid4s) and are written in
    batches of ``batch_size`` to the store ``client``: ``shape="records"``
    sends ``(id, vector, metadata)``, ``shape="fields"`` sends the vector with
    the value fields as columns.  Returns the written records (lazily: using
    the DataFrame again recomputes it).
    """
    from ..sources.vectorstore import write_vectors
    from .positional import slice_rows, zip_positional

    fields = [f.strip() for f in value_fields.split(",")] if isinstance(value_fields, str) else list(value_fields)
    if vec_order is None and "pos" in vectors.columns:
        vec_order = "pos"
    # The slice keeps its positions: they, not the slice's physical row order, pair it with the vectors.
    meta = slice_rows(table, start, end, order_by, pos_col="__mpos").select("__mpos", *[F.col(f"`{f}`") for f in fields])
    vec_keys = [vec_order] if isinstance(vec_order, str) else list(vec_order or [])
    zipped = zip_positional(vectors.select(vec_col, *[k for k in vec_keys if k != vec_col]), meta,
                            left_order=vec_order, right_order="__mpos", pos_col="__zpos")
    if shape == "fields":
        records = zipped.select(F.col(vec_col).cast("array<float>").alias("vector"), *[F.col(f"`{f}`") for f in fields])
    else:
        # One id per row (its position and vector), the same when the import is run again.
        from ..functions.vectors import vector_to_text

        own = F.md5(F.concat_ws("|", F.col("__zpos").cast("string"), vector_to_text(vec_col)))
        records = vector_records(zipped, vec_col, id_expr=own, value_fields=fields)
    write_vectors(records, client, batch_size, shape)
    return records
