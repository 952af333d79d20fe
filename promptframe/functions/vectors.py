"""Vector expressions on ``array<float>`` / ``array<double>`` columns.

These are Catalyst higher-order functions, fine for per-row work (a norm, one
query against one vector).  Scoring a block of queries against a block of
vectors is done with numpy inside ``mapInPandas`` (operators.vectors).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(col) -> Column:
    """Cast elements to double before arithmetic (float products lose bits)."""
    return F.transform(_c(col), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has zero norm."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def parse_vector_text(col) -> Column:
    """``"[0.1, 0.2]"`` -> array<double>; malformed text -> null."""
    return F.from_json(_c(col), "array<double>")


def vector_to_text(col) -> Column:
    """array<float> -> ``"[x, y, ...]"`` with each element printed as a double."""
    return F.concat(F.lit("["), F.array_join(F.transform(_c(col), lambda x: x.cast("double").cast("string")), ", "),
                    F.lit("]"))
