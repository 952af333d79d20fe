"""Landmark spectral clustering against the eigenvectors of the full affinity matrix, and on planted shapes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptframe.operators import spectral as S
from promptframe.operators.cluster import cluster_vectors


def _frame(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 "id long, vector array<double>").repartition(parts)


def _full(x, k, gamma):
    """Places by the eigenvectors of the whole normalised affinity."""
    a = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    d = np.sqrt(a.sum(1))
    values, vectors = np.linalg.eigh(a / d[:, None] / d[None])
    return vectors[:, ::-1][:, :k] / d[:, None] * np.sqrt((d * d).sum())


def test_all_rows_as_landmarks_give_the_full_affinity(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6)) + 2 * rng.integers(0, 2, (90, 6))
    places, own = S.spectral_places(_frame(spark, x), 4, 0.2, landmarks=500)
    got = np.asarray([r["place"] for r in places.orderBy("id").collect()])
    want = _full(x, 4, 0.2)
    assert np.allclose(np.abs(got[:, 0]), 1, atol=1e-6)
    for j in range(4):  # eigenvectors are equal up to their sign
        assert min(np.abs(got[:, j] - want[:, j]).max(), np.abs(got[:, j] + want[:, j]).max()) < 1e-5
    assert own.shape == (90, 4)


def _agreement(a, b):
    return len({(x, y) for x, y in zip(a, b)}) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("landmarks", [60, 5000])
def test_planted_groups_come_back(spark, landmarks):
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 6, 1500)
    x = np.eye(6)[truth] * 5 + rng.normal(size=(1500, 6)) * 0.4
    got = cluster_vectors(_frame(spark, x), "id", "vector", 6, label_base=3, landmarks=landmarks, gamma=0.5).collect()
    labels = [r["Cluster"] for r in sorted(got, key=lambda r: r["id"])]
    assert len(labels) == 1500 and _agreement(labels, truth.tolist()) and set(labels) == set(range(3, 9))
    first = {}
    for label in labels:
        first.setdefault(label, len(first) + 3)
    assert all(a == b for a, b in first.items())  # numbered by first member


def test_rings_that_no_centre_separates(spark):
    rng = np.random.default_rng(2)
    truth = np.arange(800) % 2
    angle, radius = rng.uniform(0, 2 * np.pi, 800), np.where(truth, 3.0, 1.0) + rng.normal(size=800) * 0.05
    x = np.c_[radius * np.cos(angle), radius * np.sin(angle)]
    got = cluster_vectors(_frame(spark, x), "id", "vector", 2, gamma=4.0, landmarks=300).collect()
    assert _agreement([r["Cluster"] for r in sorted(got, key=lambda r: r["id"])], truth.tolist())
    plain = cluster_vectors(_frame(spark, x), "id", "vector", 2, method="kmeans").collect()
    assert not _agreement([r["Cluster"] for r in sorted(plain, key=lambda r: r["id"])], truth.tolist())


def test_edge_rows(spark):
    """Null vectors get no label, a row out of every kernel's reach and repeated rows get one; the split changes nothing."""
    x = np.r_[np.zeros((20, 3)), np.ones((20, 3)) * 4, [[1e6, 0, 0]]]
    df = _frame(spark, x).union(spark.createDataFrame([(99, None)], "id long, vector array<double>"))
    got = {r["id"]: r["Cluster"] for r in cluster_vectors(df, "id", "vector", 2, landmarks=10).collect()}
    assert got[99] is None and len({got[i] for i in range(20)}) == len({got[i] for i in range(20, 40)}) == 1
    assert got[0] != got[20] and got[40] is not None
    again = cluster_vectors(df.repartition(2, F.col("id") % 7), "id", "vector", 2, landmarks=10).collect()
    assert {r["id"]: r["Cluster"] for r in again} == got
    bad = df.union(spark.createDataFrame([(100, [1.0])], "id long, vector array<double>"))
    with pytest.raises(Exception, match="unequal length"):
        cluster_vectors(bad, "id", "vector", 2, landmarks=500).collect()
