"""Bag-of-words tokens, as scikit-learn's ``CountVectorizer()`` defaults.

``CountVectorizer`` lower-cases and takes ``(?u)\\b\\w\\w+\\b``: maximal runs of
two or more word characters.  Java's ``\\w`` is ASCII-only, so the word class is
spelled with Unicode properties; the same pattern runs in RE2 (DuckDB).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the token rule (two or more letters, digits or underscores).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(col) -> Column:
    """array<string> of lower-cased tokens, in text order, with repeats."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))
