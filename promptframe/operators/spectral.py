"""Spectral clustering that is linear in the rows: landmark (Nystrom) features of the full RBF affinity.

Spectral clustering takes the leading eigenvectors of the normalised affinity matrix of all rows.  With ``m``
landmark rows, the affinity of two rows is taken through the landmarks,
``A = C W^-1 C'`` (``C`` rows x landmarks, ``W`` landmarks x landmarks), so every row is linked with every other,
no neighbour is searched and no edge is cut.  Three passes over the vectors, each ``rows * m`` kernel values:

1. column sums of ``C``, which give every row's degree ``c W^-1 (C' 1)``;
2. the Gram matrix (``m x m``) of the normalised features ``c W^-1/2 / sqrt(degree)``, whose eigenvectors are those of
   the affinity seen from the features' side;
3. every row's place among the leading eigenvectors (``k`` numbers), written as a table.

k-means then runs over that table: centres start from the landmarks' own places, every turn is one
aggregation of ``k * (k + 1)`` sums.  Tasks hold one block of rows and one ``m x m`` matrix; partial matrices are cut
into rows that ``REDUCERS`` tasks add up, so the driver gets each sum once.  It holds ``m x m`` matrices only.

Landmarks are a documented bounded sample: the ``landmarks`` rows with the least hash of their id, all rows if
there are no more than that, in which case the result is that of the full affinity matrix, without approximation.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, spread

LANDMARKS = 512
REDUCERS = 32
BLOCK_ROWS = 2048
TURNS, SETTLED, STARTS = 12, 1e-7, 10
#: Eigenvalues below this share of the largest one are rounding, not kernel.
CUT = 1e-10


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column as float64 rows; all must be of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of unequal length")
    return flat.reshape(len(column), -1)


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """``exp(-gamma |x - y|^2)`` for all rows of both."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(square, 0))


class Features(NamedTuple):
    """What a task needs to place a row: landmarks, ``W^-1/2``, degrees' weights."""

    landmarks: np.ndarray
    gamma: float
    half: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalised features and the square roots of the degrees."""
        c = rbf(x, self.landmarks, self.gamma)
        # A row out of every landmark's reach has no affinity left: no features, and a degree that is not zero.
        degree = np.sqrt(np.maximum(c @ self.weights, 1e-12))
        return c @ self.half / degree[:, None], degree


def _blocks(batches, at: int = 0):
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(first, BLOCK_ROWS)
            yield part, matrix(part.column(at))


def _added(df: DataFrame, partial, rows: int, width: int) -> np.ndarray:
    """Sum over all blocks of the matrix ``partial(x)``: tasks first, then ``REDUCERS`` tasks, each some of its rows."""
    schema = "row int, part binary"

    def own(batches):
        total = np.zeros((rows, width))
        for _, x in _blocks(batches):
            total += partial(x)
        for first in range(0, rows, BLOCK_ROWS):
            some = range(first, min(rows, first + BLOCK_ROWS))
            yield pa.RecordBatch.from_pydict({"row": pa.array(some, pa.int32()),
                                              "part": pa.array([total[i].tobytes() for i in some], pa.binary())})

    def merge(batches):
        total = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(raw.as_buffer())
                total[i] = total[i] + part if i in total else part.copy()
        yield pa.RecordBatch.from_pydict({"row": pa.array(list(total), pa.int32()),
                                          "part": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    out = np.zeros((rows, width))
    for r in df.mapInArrow(own, schema).repartition(REDUCERS, "row").mapInArrow(merge, schema).collect():
        out[r["row"]] = np.frombuffer(r["part"])
    return out


def landmark_rows(rows: DataFrame, n: int, landmarks: int) -> list:
    """The ``landmarks`` rows (id, vector) with the least hash of the id; only candidates leave a task."""
    hashed = rows.select(F.xxhash64("id").alias("h"), "id", "vector")
    if n > 4 * landmarks:  # a bound that lets about four times as many through
        hashed = hashed.where(F.col("h") < F.lit(int(-(1 << 63) + (1 << 64) * 4 * landmarks // n)))
    return hashed.orderBy("h", "id").limit(landmarks).collect()


def spectral_places(rows: DataFrame, k: int, gamma: float = 1.0, landmarks: int = LANDMARKS,
                    n: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(id, place) of every row of ``rows`` (id long, vector array<double>), and the landmarks' own places.

    A place has ``k`` numbers: the row's entries in the leading eigenvectors, divided by the root of its degree.
    """
    spark = rows.sparkSession
    ship_package(spark)
    n = rows.count() if n is None else n
    chosen = [r["vector"] for r in landmark_rows(rows, n, landmarks)]
    if len({len(v) for v in chosen}) > 1:
        raise ValueError("vectors of unequal length")
    marks = np.asarray(chosen, np.float64)
    w = rbf(marks, marks, gamma)
    values, vectors = np.linalg.eigh(w)
    keep = values > CUT * values[-1]
    half = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    m = len(marks)
    sums = _added(rows.select("vector"), lambda x: rbf(x, marks, gamma).sum(0), 1, m)[0]
    features = Features(marks, gamma, half, half @ (half @ sums))

    def gram(x):
        phi, _ = features(x)
        return phi.T @ phi

    values, vectors = np.linalg.eigh(_added(rows.select("vector"), gram, m, m))
    lead = np.argsort(-values)[:k]
    # The rows' eigenvectors have the singular values' length: scaled so that the constant one is 1 everywhere.
    volume = float(sums @ features.weights)
    project = vectors[:, lead] * np.sqrt(max(volume, 1e-300) / np.maximum(values[lead], 1e-300))

    def place(x):
        phi, degree = features(x)
        return phi @ project / degree[:, None]

    def run(batches):
        for part, x in _blocks(batches, 1):
            found = place(x)
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["id", "place"])

    path = scratch_path(spark, "spectral")
    rows.select("id", "vector").mapInArrow(run, "id long, place array<double>").write.parquet(path)
    return spark.read.schema("id long, place array<double>").parquet(path), place(marks)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (-2 * x @ centres.T + (centres * centres).sum(1)[None]).argmin(1)


def start_centres(places: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Best of ``STARTS`` k-means over the landmarks' places, each from spread-out starts."""
    best, best_cost = None, np.inf
    rng = np.random.default_rng(seed)
    for _ in range(STARTS):
        centres = places[rng.integers(len(places))][None]
        while len(centres) < k:
            far = ((places[:, None] - centres[None]) ** 2).sum(-1).min(1)
            total = far.sum()
            pick = rng.choice(len(places), p=far / total) if total > 0 else rng.integers(len(places))
            centres = np.vstack([centres, places[pick]])
        for _ in range(50):
            label = _nearest(places, centres)
            moved = np.stack([places[label == c].mean(0) if (label == c).any() else centres[c] for c in range(k)])
            if np.abs(moved - centres).max() < SETTLED:
                break
            centres = moved
        cost = ((places - centres[_nearest(places, centres)]) ** 2).sum()
        if cost < best_cost - 1e-12:
            best, best_cost = centres, cost
    return best


def spectral_clusters(rows: DataFrame, k: int, gamma: float = 1.0, landmarks: int = LANDMARKS, seed: int = 0,
                      turns: int = TURNS, n: int | None = None) -> DataFrame:
    """(id, cluster) of every row of ``rows`` (id long, vector array<double>, no nulls)."""
    places, own = spectral_places(spread(rows), k, gamma, landmarks, n)
    centres = start_centres(own, k, seed)
    width = centres.shape[1]
    for _ in range(turns):
        def sums(x, centres=centres):
            label = _nearest(x, centres)
            out = np.zeros((k, width + 1))
            np.add.at(out, label, np.hstack([x, np.ones((len(x), 1))]))
            return out

        total = _added(places.select("place"), sums, k, width + 1)
        moved = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), centres)
        settled = np.abs(moved - centres).max(initial=0) < SETTLED
        centres = moved
        if settled:
            break

    def label(batches):
        for part, x in _blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_nearest(x, centres).astype(np.int32))], ["id", "cluster"])

    return places.mapInArrow(label, "id long, cluster int")
