"""Clustering of vector rows (CLU1-CLU3).

The reference runs scikit-learn spectral clustering (RBF affinity, gamma 1)
on one machine.  ``method='spectral'`` is its distributed counterpart over the full affinity, linear in the
rows (see ``spectral``).  ``method='pic'`` is Spark ML's Power Iteration
Clustering, a spectral method on a sparse affinity graph: each vector is
linked to its ``n_neighbors`` nearest vectors (exact kNN, see
``vectors.knn_search``) with weight ``exp(-gamma * |x - y|^2)``, each
undirected edge fed once.  ``method='kmeans'`` uses Spark ML KMeans instead.  Labels cannot equal
scikit-learn's number for number; they are deterministic for a given input
(the graph's split is fixed by its size, and clusters are numbered by their smallest member id).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spectral import LANDMARKS, spectral_clusters

# Edges per partition of the affinity graph handed to Power Iteration Clustering.
EDGES_PER_PARTITION = 4_000_000


class ClusterGuard(Exception):
    """A guard of the reference: the table is returned unchanged."""


def cluster_vectors(df: DataFrame, id_col: str, vec_col: str, clusters: int = 10, label_base: int = 0,
                    method: str = "spectral", n_neighbors: int = 10, gamma: float = 1.0, max_iter: int = 20,
                    seed: int = 0, out: str = "Cluster", landmarks: int = LANDMARKS) -> DataFrame:
    """``id, out`` with labels in ``[label_base, label_base + clusters)``.

    ``id_col`` must be an integer key.  A row without a vector gets a null label.
    Raises ``ClusterGuard`` for <= 1 row or fewer rows than clusters (CLU2).
    """
    n = df.count()
    if n <= 1:
        raise ClusterGuard("Input dataframe or embeddings file is empty")
    if n < clusters:
        raise ClusterGuard("The number of clusters should be less than the number of data points")
    if method == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        feats = df.select(F.col(id_col).cast("long").alias("id"),
                          array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
        model = KMeans(k=clusters, seed=seed, maxIter=max_iter).fit(feats)
        assigned = model.transform(feats).select("id", F.col("prediction").alias("cluster"))
        return _numbered(assigned, assigned.select("id"), id_col, label_base, out)
    if method == "spectral":
        every = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
        assigned = spectral_clusters(every.where("vector is not null"), clusters, gamma, landmarks, seed)
        return _numbered(assigned, every.select("id"), id_col, label_base, out)
    if method != "pic":
        raise ValueError("method must be 'spectral', 'pic' or 'kmeans'")
    from pyspark.ml.clustering import PowerIterationClustering

    from .vectors import knn_search

    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vector"))
    nn = knn_search(v.withColumnRenamed("id", "q_id"), v, k=n_neighbors, q_id="q_id", s_id="id",
                    metric="rbf", gamma=gamma, exclude_self=True)
    # The iteration's sums depend on how the edges are split, so the split is
    # fixed by the data, not by the session: partitions sized by edge count
    # (an explicit count AQE leaves alone), rows sorted within each.
    parts = max(1, math.ceil(n * n_neighbors / EDGES_PER_PARTITION))
    edges = (nn.select(F.least("q_id", "s_id").alias("src"), F.greatest("q_id", "s_id").alias("dst"),
                       F.col("score").alias("weight"))
             .groupBy("src", "dst").agg(F.max("weight").alias("weight"))
             .repartition(parts, "src").sortWithinPartitions("src", "dst"))
    pic = PowerIterationClustering(k=clusters, maxIter=max_iter, initMode="degree", srcCol="src", dstCol="dst",
                                   weightCol="weight")
    return _numbered(pic.assignClusters(edges), v.select("id"), id_col, label_base, out)


def _numbered(assigned: DataFrame, ids: DataFrame, id_col: str, label_base: int, out: str) -> DataFrame:
    """Canonical labels: clusters ordered by their smallest member id, plus ``label_base``.

    The numbering window sees one row per cluster (at most ``clusters``
    rows), and only that small table is broadcast.  Ids without a cluster
    (no edge in the graph) get null.
    """
    first = assigned.groupBy("cluster").agg(F.min("id").alias("_first"))
    number = first.select("cluster", (F.row_number().over(Window.orderBy("_first")) - 1).alias("_label"))
    labels = ids.join(assigned, "id", "left").join(F.broadcast(number), "cluster", "left")
    return labels.select(F.col("id").alias(id_col), (F.col("_label") + F.lit(label_base)).cast("int").alias(out))


def write_back(df: DataFrame, labels: DataFrame, start: int, end: int, field: str = "Cluster",
               recreate: bool = False, order_by=None, label_col: str = "label") -> DataFrame:
    """Write labels into rows ``[start, end)`` of ``field`` (CLU3).

    ``labels`` holds ``pos`` (0 = row ``start``) and ``label``.  ``recreate``
    drops an existing ``field`` first; a missing field is created as null;
    rows outside the slice keep their value.  The label count must equal
    ``end - start`` (CLU2), else ``ClusterGuard``.
    """
    from .positional import with_pos

    if labels.count() != end - start:
        raise ClusterGuard("The number of vectors and data points should be the same")
    base = df.drop(field) if recreate and field in df.columns else df
    if field not in base.columns:
        base = base.withColumn(field, F.lit(None).cast("int"))
    staged = with_pos(base, order_by, "__pos")
    lab = labels.select((F.col("pos") + F.lit(start)).alias("__pos"), F.col(label_col).alias("__label"))
    joined = staged.join(lab, "__pos", "left")
    in_slice = (F.col("__pos") >= start) & (F.col("__pos") < end)
    return joined.select(*[F.when(in_slice, F.col("__label")).otherwise(F.col(f"`{c}`")).alias(c) if c == field
                           else F.col(f"`{c}`") for c in base.columns])


def cluster_table(df: DataFrame, vectors: DataFrame | None, vec_col: str = "vector", field: str = "Cluster",
                  clusters: int = 10, label_base: int = 0, start: int = 0, end: int | None = None,
                  recreate: bool = False, order_by=None, vec_order=None, method: str = "spectral", **options) -> DataFrame:
    """Cluster a vector table and write the labels into rows ``[start, end)`` of ``df`` (CLU1-CLU3 in one call).

    Guards, in the reference's order, raise ``ClusterGuard`` (the caller keeps
    its table unchanged): ``df`` has at most one row or there are no vectors;
    fewer vectors than clusters; a vector count other than ``end - start``.
    Vectors are numbered by ``vec_order`` (default: the ``pos`` column that
    ``format("npy")`` gives, else their input order); vector ``i`` labels row
    ``start + i`` of ``df`` under ``order_by``.  ``options`` go to
    ``cluster_vectors`` (``gamma``, ``landmarks``, ``n_neighbors``, ``max_iter``, ``seed``).
    """
    from .positional import with_pos

    if vectors is None or df.limit(2).count() <= 1:
        raise ClusterGuard("Input dataframe or embeddings file is empty")
    if vec_order is None and "pos" in vectors.columns:
        vec_order = "pos"
    numbered, n = with_pos(vectors.select(vec_col, *([vec_order] if isinstance(vec_order, str) else vec_order or [])),
                           vec_order, "__vpos", return_count=True)
    if n < clusters:
        raise ClusterGuard("The number of clusters should be less than the number of data points")
    end = start + n if end is None else end
    if n != end - start:
        raise ClusterGuard("The number of vectors and data points should be the same")
    labels = cluster_vectors(numbered, "__vpos", vec_col, clusters, label_base, method, out="__label", **options)
    return write_back(df, labels.select(F.col("__vpos").alias("pos"), F.col("__label").alias("label")),
                      start, end, field, recreate, order_by)
