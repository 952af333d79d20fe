"""Embedding maps (EMB1-EMB3).

Texts are embedded in fixed-size batches inside ``mapInArrow``, ``ROWS`` rows at a time; the
embedder is built once per Python worker from an options dict.  The vector
stays on its row (the reference glues vectors to a slice by position and
misaligns them when the slice does not start at 0).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir, ship_package, spread


#: Rows embedded before they are handed on (in whole batches): no more texts and vectors are Python objects at a time.
ROWS = 256


def _embed_mapper(key_col, out, opts, batch_size):
    step = batch_size * max(1, ROWS // batch_size)

    def run(batches):
        from promptframe.operators.clients import make_embedder

        model = make_embedder(opts)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                # Blank keys become one space (embedders reject empty input).
                texts = [" " if (v is None or v == "") else v for v in part.column(key_col).to_pylist()]
                vecs = []
                for i in range(0, len(texts), batch_size):
                    vecs.extend(model.embed(texts[i:i + batch_size]))
                vecs = pa.array([None if v is None else np.asarray(v, np.float32) for v in vecs], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, vecs], [*part.schema.names, out])
    return run


def embed_rows(df: DataFrame, key_col: str, embedder: dict, batch_size: int = 1, out: str = "Vector") -> DataFrame:
    """Add ``out: array<float>`` = embedding of ``key_col`` (EMB1 core)."""
    if int(batch_size) < 1:
        raise ValueError("batch_size must be >= 1")
    ship_package(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType(fields + [T.StructField(out, T.ArrayType(T.FloatType()))])
    src = spread(df.select(*[F.col(f"`{f.name}`") for f in fields]))
    return src.mapInArrow(_embed_mapper(key_col, out, embedder, int(batch_size)), schema)


def embed_table(df: DataFrame, key_field: str, value_fields: str | list[str], embedder: dict, start=None, end=None,
                order_by=None, batch_size: int = 1) -> DataFrame:
    """Embed the key field of rows ``[start, end)``: ``Vector`` + value fields (EMB1).

    ``value_fields`` is a comma-separated list (trimmed) or a list.
    """
    from .positional import slice_rows

    values = [v.strip() for v in value_fields.split(",")] if isinstance(value_fields, str) else list(value_fields)
    rows = df
    if start is not None or end is not None:
        rows = slice_rows(rows, start, end, order_by, keep_pos=False)
    keep = list(dict.fromkeys([key_field] + values))
    emb = embed_rows(rows.select(*[F.col(f"`{c}`") for c in keep]), key_field, embedder, batch_size)
    return emb.select("Vector", *[F.col(f"`{v}`") for v in values])


def embed_import(df: DataFrame, key_field: str, value_fields: str | list[str], embedder: dict, client: dict, start=None,
                 end=None, order_by=None, batch_size: int = 1, shape: str = "records", id_field: str | None = None) -> DataFrame:
    """Embed the key field of rows ``[start, end)`` and write them to a store, in one call (EMB3).

    Every row is one record, also where texts repeat: the id is the digest of
    ``id_field`` if one is named, else of the row's number in the embedded table
    and its vector.  The embedded rows go to a checkpoint before their two uses, the
    store and the returned records, so the model is called once per batch.  A vector stays on its row, so no
    count check is needed.  ``shape`` as in ``import_vectors``.
    """
    from ..sources.vectorstore import write_vectors
    from .vectors import vector_records

    values = [v.strip() for v in value_fields.split(",")] if isinstance(value_fields, str) else list(value_fields)
    carried = list(dict.fromkeys(values + ([id_field] if id_field else [])))
    checkpoint_dir(df.sparkSession)
    emb = embed_table(df, key_field, carried, embedder, start, end, order_by, batch_size).checkpoint()
    if shape == "fields":
        records = emb.select(F.col("Vector").alias("vector"), *[F.col(f"`{v}`") for v in values])
    else:
        own = F.md5(F.col(f"`{id_field}`").cast("string")) if id_field else None
        records = vector_records(emb, "Vector", id_expr=own, value_fields=values)
    write_vectors(records, client, batch_size, shape)
    return records


def embed_text(spark, text: str, embedder: dict):
    """One text -> its vector (EMB2), via the same distributed path."""
    df = spark.createDataFrame([(text,)], "text string")
    return embed_rows(df, "text", embedder).first()["Vector"]
