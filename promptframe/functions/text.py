"""String helpers with Python string semantics, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes by default
# (str.isspace), written as one regex class that Java and RE2 both accept.
PY_WHITESPACE = (
    r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


# The same characters as a plain string, for ``btrim`` (a character set, no regex).
PY_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                       + "".join(chr(c) for c in range(0x2000, 0x200B))
                       + "\u2028\u2029\u202f\u205f\u3000")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()``: remove leading and trailing whitespace (Unicode set)."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE_CHARS))


def strip_chars(col, chars: str) -> Column:
    """``str.strip(chars)`` for a literal character set."""
    return F.btrim(_c(col), F.lit(chars))


def quote_regex(literal: str) -> str:
    """Java-regex literal quoting (``Pattern.quote``)."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_literal(col, sep: str) -> Column:
    """``str.split(sep)`` for a literal separator, as array<string>."""
    return F.split(_c(col), quote_regex(sep))


def split_part_py(col, sep: str, index: int) -> Column:
    """``text.split(sep)[index]`` (0-based); null where Python raises IndexError."""
    return F.try_element_at(split_literal(col, sep), F.lit(index + 1))


def truncate(col, n: int) -> Column:
    """``(s or '')[:n]``."""
    return F.substring(F.coalesce(_c(col), F.lit("")), 1, n)


def contains_ci(col, needle: str) -> Column:
    """Case-insensitive substring test, ``needle.lower() in s.lower()``."""
    return F.contains(F.lower(_c(col)), F.lit(needle.lower()))
