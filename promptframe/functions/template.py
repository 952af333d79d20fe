"""`{name}` templates compiled to Catalyst ``concat`` expressions.

A template is parsed once on the driver with ``string.Formatter().parse`` and
becomes ``concat(lit, col, lit, ...)``: no Python per row, constant folding
for literal-only templates, and column pruning down to the scan (only the
placeholders' columns are read).  Semantics follow ``str.format``: values are
not re-expanded, ``{{`` / ``}}`` are literal braces.  A null value renders as
the empty string.  Conversions (``!r``) and format specs are rejected at plan
time, as are placeholders that name neither a column nor a given value.
"""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def placeholders(template: str) -> list[str]:
    """Names used by a template, in first-use order, without repeats."""
    seen: list[str] = []
    for _, name, spec, conv in string.Formatter().parse(template):
        if name is None:
            continue
        if name == "" or name.isdigit():
            raise ValueError(f"positional placeholder in template: {template!r}")
        if spec or conv:
            raise ValueError(f"format spec / conversion not supported: {{{name}!{conv}:{spec}}}")
        if name not in seen:
            seen.append(name)
    return seen


def _as_text(value) -> Column:
    col = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(col.cast("string"), F.lit(""))


def render(template: str, values: Mapping[str, object] | None = None) -> Column:
    """Compile ``template`` to a string Column.

    ``values`` maps a placeholder to a Column or a Python literal; any other
    placeholder is taken as a column of the same name.
    """
    values = values or {}
    parts: list[Column] = []
    for literal, name, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if name == "" or name.isdigit() or spec or conv:
            placeholders(template)  # raises with a precise message
        parts.append(_as_text(values[name]) if name in values else _as_text(F.col(f"`{name}`")))
    if not parts:
        return F.lit("")
    return parts[0] if len(parts) == 1 else F.concat(*parts)
