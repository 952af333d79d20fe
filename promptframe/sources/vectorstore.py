"""Batched writes of vector rows to a vector store (SNK5, SNK6).

``df.write.format("vectorstore")`` hands each task's rows to a store client in
batches of ``batchSize``; tasks write in parallel, each with its own client
(the reference sends asynchronous batches from one process and waits for
all of them).  Two row shapes:

* ``shape="records"`` (Pinecone-style upsert): the input has ``id``,
  ``vector`` and optionally ``metadata`` (``map<string,string>``) and ``text``;
  a non-null ``text`` is added to the metadata under ``"text"``;
* ``shape="fields"`` (Milvus-style insert): every column becomes a field of
  the entity, the vector included.

Options: ``client`` (JSON of the store options, ``{"type": ..., ...}``; see
``operators.clients``), ``batchSize`` (default 100), ``shape``.  Upserts by
id are idempotent, so a retried task repeats its batches harmlessly; use
``vector_records`` ids (digests of the row) rather than random ones.  Plain
inserts (the Milvus client's default, as in the reference) are repeated by a
retried task; its ``upsert`` option avoids that.
"""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _plain(v):
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def to_record(row: dict, shape: str) -> dict:
    """One Spark row (as a dict) -> the store's item shape."""
    if shape == "fields":
        return {k: _plain(v) for k, v in row.items()}
    if row.get("id") is None or row.get("vector") is None:
        raise ValueError(f"vector-store record needs an id and a vector: id={row.get('id')!r}")
    meta = dict(row.get("metadata") or {})
    if row.get("text") is not None:
        meta.setdefault("text", row["text"])
    return {"id": row["id"], "vector": [float(x) for x in row["vector"]], "metadata": meta}


class _Commit(WriterCommitMessage):
    def __init__(self, rows, batches):
        self.rows, self.batches = rows, batches


class VectorStoreWriter(DataSourceWriter):
    def __init__(self, client: dict, batch_size: int, shape: str, columns: list[str]):
        self.client, self.batch_size, self.shape, self.columns = client, batch_size, shape, columns

    def write(self, iterator):
        from pyspark import TaskContext

        from promptframe.operators.clients import make_vector_store

        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        store = make_vector_store(self.client)
        batch, rows, batches = [], 0, 0
        for r in iterator:
            batch.append(to_record(dict(zip(self.columns, r)), self.shape))
            if len(batch) == self.batch_size:
                store.write(batch, f"{pid:05d}-{batches:06d}")
                rows, batches, batch = rows + len(batch), batches + 1, []
        if batch:
            store.write(batch, f"{pid:05d}-{batches:06d}")
            rows, batches = rows + len(batch), batches + 1
        return _Commit(rows, batches)

    def commit(self, messages):
        self.written = sum(m.rows for m in messages if m), sum(m.batches for m in messages if m)


class VectorStoreDataSource(DataSource):
    """``format("vectorstore")``: options ``clientSecret`` or ``client`` (JSON), ``batchSize``, ``shape``.

    ``write_vectors`` uses ``clientSecret``: the JSON may hold an API key, and Spark blanks out
    option values whose name says so in plans and event logs.
    """

    @classmethod
    def name(cls):
        return "vectorstore"

    def writer(self, schema, overwrite):
        shape = self.options.get("shape", "records")
        if shape not in ("records", "fields"):
            raise ValueError("shape must be 'records' or 'fields'")
        names = [f.name for f in schema.fields]
        if shape == "records" and not {"id", "vector"} <= set(names):
            raise ValueError("shape 'records' needs 'id' and 'vector' columns")
        size = int(self.options.get("batchSize", 100))
        if size < 1:
            raise ValueError("batchSize must be >= 1")
        return VectorStoreWriter(json.loads(self.options.get("clientSecret") or self.options["client"]), size, shape, names)


def register(spark) -> None:
    spark.dataSource.register(VectorStoreDataSource)


def write_vectors(df, client: dict, batch_size: int = 100, shape: str = "records") -> None:
    """Write ``df`` to the store described by ``client`` (SNK5 / SNK6)."""
    from ..session import ship_package

    ship_package(df.sparkSession)
    register(df.sparkSession)
    (df.write.format("vectorstore").mode("append").option("clientSecret", json.dumps(client))
     .option("batchSize", int(batch_size)).option("shape", shape).save())
