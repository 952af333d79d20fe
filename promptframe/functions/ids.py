"""Deterministic ids.

The reference draws random ids (ObjectId, 16 random bytes, uuid4).  Random
ids make a retried task write different keys, so ids here are a digest of
the row key: a re-run or a lost executor reproduces the same id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u0001"


def hex_id(*cols, length: int = 32, salt: str = "") -> Column:
    """First ``length`` hex digits of md5(salt, key columns)."""
    parts = [F.lit(salt)] + [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
                             for c in cols]
    return F.substring(F.md5(F.concat_ws(SEP, *parts)), 1, length)


def object_id(*cols, salt: str = "") -> Column:
    """24 hex digits, the shape of a BSON ObjectId."""
    return hex_id(*cols, length=24, salt=salt)


def hash_index(n, *cols, salt: str = "") -> Column:
    """Non-negative integer in [0, n) from md5 of the key (first 15 hex digits, 60 bits)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(SEP, F.lit(salt), *[F.col(c).cast("string") if isinstance(c, str)
                                                                   else c.cast("string") for c in cols])), 1, 15),
               16, 10).cast("long")
    return F.pmod(h, n if isinstance(n, Column) else F.lit(n))
