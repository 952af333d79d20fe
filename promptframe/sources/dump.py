"""Multi-format dump (SNK3): one write per requested format.

Nothing is written for a missing table or one with fewer than two rows
(checked with ``limit(2)``, not a full count); unknown formats are ignored.
The table is persisted while several formats are written from it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from ..session import ship_package
from . import xlsx
from .csv import write_csv


def dump(df: DataFrame | None, path: str, formats=("csv", "xlsx")) -> list[str] | None:
    """Write ``df`` under ``path/<format>`` per known format; returns the written dirs."""
    if df is None or df.limit(2).count() < 2:
        return None
    known = [f for f in formats if f in ("csv", "xlsx")]
    out = []
    cached = df.persist() if len(known) > 1 else df
    try:
        for f in known:
            target = os.path.join(path, f)
            if f == "csv":
                write_csv(cached, target)
            else:
                ship_package(df.sparkSession)
                xlsx.register(df.sparkSession)
                cached.write.format("xlsx").mode("overwrite").save(target)
            out.append(target)
    finally:
        if cached is not df:
            cached.unpersist()
    return out
