"""Store writes in two steps: staged batches, then a commit that sends only what is missing (SNK5, SNK6).

``stage_vectors`` writes the rows as batches, each with a key of its own, to a shared folder; the
written table is the manifest.  ``commit_vectors`` sends every batch whose key the folder's log does not hold and
records each as soon as the store has taken it, so after a failure a second commit goes on
where the first one ended and plain inserts are not repeated.  It returns only when the log holds every
batch.  The one gap left is a machine lost between a store's answer and its record; the store gets the
batch's key with the rows, so one that knows request keys can close it.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import read_log, run_logged
from ..session import ship_package
from .vectorstore import to_record


def stage_vectors(df: DataFrame, path: str, batch_size: int = 100, shape: str = "records") -> None:
    """Write the rows of ``df`` as batches of ``batch_size`` below ``path``, which must not exist yet.

    Rows without id or vector raise under ``shape='records'``; an empty table stages no batch.
    """
    if shape not in ("records", "fields"):
        raise ValueError("shape must be 'records' or 'fields'")
    if shape == "records" and not {"id", "vector"} <= set(df.columns):
        raise ValueError("shape 'records' needs 'id' and 'vector' columns")
    if int(batch_size) < 1:
        raise ValueError("batch_size must be >= 1")
    ship_package(df.sparkSession)
    size = int(batch_size)

    def batches_of(tables):
        from pyspark import TaskContext

        task, held, n = TaskContext.get().partitionId(), [], 0
        for t in tables:
            held += [to_record(r, shape) for r in t.to_pylist()]
            while len(held) >= size:
                yield _batch(task, n, held[:size])
                held, n = held[size:], n + 1
        if held:
            yield _batch(task, n, held)

    maps = [c for c, t in df.dtypes if t.startswith("map<")]
    # Arrow hands maps over as lists of pairs: they travel as objects instead.
    plain = df.select(*[F.to_json(f"`{c}`", {"ignoreNullFields": "false"}).alias(c) if c in maps else F.col(f"`{c}`") for c in df.columns])

    def rows_of(tables):
        return batches_of(_maps_back(tables, maps))

    plain.mapInArrow(rows_of, "call_key string, rows int, payload string").write.parquet(path)


class _Rows:
    """A batch whose JSON columns are objects again."""

    def __init__(self, batch, maps):
        self.batch, self.maps = batch, maps

    def to_pylist(self):
        rows = self.batch.to_pylist()
        for r in rows:
            for c in self.maps:
                r[c] = json.loads(r[c]) if r[c] is not None else None
        return rows


def _maps_back(tables, maps):
    return (_Rows(t, maps) for t in tables)


def _batch(task: int, n: int, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "call_key": pa.array([f"{task:06d}-{n:08d}"]), "rows": pa.array([len(rows)], pa.int32()),
        "payload": pa.array([json.dumps(rows, ensure_ascii=False)])})


def commit_vectors(spark: SparkSession, path: str, client: dict) -> tuple[int, int]:
    """Send the staged batches that are not yet in the store; returns (batches sent now, rows staged in all).

    Raises at the first failed batch; calling it again sends the rest.
    """
    opts, log = dict(client), f"{path.rstrip('/')}-sent"

    def make_work():
        from promptframe.operators.clients import make_vector_store

        store = make_vector_store(opts)
        return lambda key, payload: store.write(json.loads(payload), key)

    staged = spark.read.schema("call_key string, rows int, payload string").parquet(path)
    sent = run_logged(staged, make_work, log, flush=1, on_error="fail")["sent"]
    held = staged.join(read_log(spark, log).where("status = 'ok'").select("call_key").distinct(), "call_key", "left_semi")
    total, there = staged.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first(), held.count()
    if there != total[0]:
        raise RuntimeError(f"{total[0] - there} of {total[0]} batches are not in the store")
    return sent, int(total[1])
