"""Model catalog ids from JSON listings (SRC7, CAT1, CAT2, JS3).

A listing is ``{"data": [{"id": ...}, ...]}``; it is read with ``from_json``
(or ``spark.read.json`` with ``multiLine`` for files) and exploded, keeping
each id's position in its listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTING_SCHEMA = "struct<data: array<struct<id: string>>>"


def model_ids(df: DataFrame, payload_col: str = "payload", keys: list[str] | None = None) -> DataFrame:
    """``keys.., idx, id`` for every entry of every listing (CAT1)."""
    keys = keys or []
    parsed = df.select(*keys, F.from_json(payload_col, LISTING_SCHEMA).alias("_p"))
    return parsed.select(*keys, F.posexplode("_p.data").alias("idx", "_e")).select(*keys, "idx", F.col("_e.id").alias("id"))


def read_listing(spark, path: str) -> DataFrame:
    """Listing files (one JSON document each) -> ``idx, id``."""
    raw = spark.read.option("multiLine", True).schema("data array<struct<id: string>>").json(path)
    return raw.select(F.posexplode("data").alias("idx", "_e")).select("idx", F.col("_e.id").alias("id"))


def with_prefix(ids: DataFrame, prefix: str = "gpt-", id_col: str = "id") -> DataFrame:
    """Keep ids that start with ``prefix`` (CAT2)."""
    return ids.where(F.startswith(F.col(id_col), F.lit(prefix)))
