"""Markdown tables in text columns (TAB1, TAB2), as Catalyst expressions.

Parsing rules of the reference parser, per text:

1. The table starts at the first ``"| "`` anywhere (also mid-line); none ->
   no table (null).
2. Header = first line split on ``|`` with the first and last piece dropped,
   each piece stripped (Python ``str.strip``).
3. A line whose stripped form starts with ``|---`` or ``| ---`` is skipped;
   ``|:---|`` is data.
4. Every other line to the end of the text is a row: split, ends dropped,
   stripped, padded with ``''`` or cut to the header width.  Prose and blank
   lines after the table therefore give all-``''`` rows.

Everything is a ``split`` / ``transform`` / ``filter`` expression on the row
that holds the text, so parsing is a narrow map with no shuffle; the long
form is a ``posexplode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import spread


def _cells(line: Column) -> Column:
    pieces = F.split(line, r"\|", -1)
    n = F.size(pieces)
    return F.transform(F.slice(pieces, 2, F.greatest(n - 2, F.lit(0))), lambda c: py_strip(c))


def _is_separator(line: Column) -> Column:
    s = py_strip(line)
    return F.startswith(s, F.lit("|---")) | F.startswith(s, F.lit("| ---"))


def parse_expr(text) -> Column:
    """struct<header: array<string>, rows: array<array<string>>>, null without a table."""
    t = F.col(text) if isinstance(text, str) else text
    start = F.locate("| ", t)
    lines = F.split(F.substring(t, start, F.lit(2147483647)), "\n", -1)
    header = _cells(F.element_at(lines, 1))
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda ln: ~_is_separator(ln))
    rows = F.transform(F.transform(body, _cells), lambda cells: F.transform(
        header, lambda _h, i: F.coalesce(F.try_element_at(cells, i + 1), F.lit(""))))
    return F.when(start > 0, F.struct(header.alias("header"), rows.alias("rows")))


def parse_staged(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep.., _h (header), _rows`` computed in three projections.

    Same result as ``parse_expr`` but each piece is computed once per row:
    Catalyst does not inline a non-trivial alias that is used twice, so the
    split lines and the header are materialised before the per-line lambdas
    use them (in one nested expression they would be re-evaluated per line).
    Rows without a table get null ``_h`` / ``_rows``.
    """
    t = F.col(text_col)
    s1 = df.select(*keep, F.locate("| ", t).alias("_start"), t.alias("_text"))
    s2 = s1.select(*keep, F.when(F.col("_start") > 0, F.split(F.substring(F.col("_text"), F.col("_start"),
                                                                          F.lit(2147483647)), "\n", -1))
                   .alias("_lines"))
    lines = F.col("_lines")
    s3 = s2.select(*keep, _cells(F.element_at(lines, 1)).alias("_h"),
                   F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))),
                            lambda ln: ~_is_separator(ln)).alias("_body"))
    s4 = s3.select(*keep, "_h", F.transform("_body", _cells).alias("_cells"))
    return s4.select(*keep, "_h", F.transform("_cells", lambda cells: F.transform(
        F.col("_h"), lambda _x, i: F.coalesce(F.try_element_at(cells, i + 1), F.lit("")))).alias("_rows"))


def _dedupe_names(header: Column) -> Column:
    """Unique header names: a name already taken gets the first free ``_2``, ``_3``... suffix.

    Names are taken left to right, so ``a, a, a_2`` becomes ``a, a_2, a_2_2``
    (Spark needs unique keys for the name -> cell map).  Among ``n + 1``
    candidates at least one is free, so a name is always found.
    """
    def take(acc, h):
        cands = F.transform(F.sequence(F.lit(2), F.size(acc) + 2), lambda k: F.concat(h, F.lit("_"), k.cast("string")))
        free = F.element_at(F.filter(cands, lambda c: ~F.array_contains(acc, c)), 1)
        return F.concat(acc, F.array(F.when(~F.array_contains(acc, h), h).otherwise(free)))

    return F.aggregate(header, F.array().cast("array<string>"), take)


def parse_markdown_table(df: DataFrame, text_col: str = "text", out: str = "table") -> DataFrame:
    """Add ``table = struct(header, rows)`` parsed from ``text_col`` (TAB1)."""
    return df.withColumn(out, parse_expr(text_col))


def markdown_cells(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Long form of each text's first table: ``keys.., row_no, col_no, col_name, cell``.

    A text without a table contributes nothing; a header-only table has no
    rows.  ``row_no`` counts data rows (separator lines skipped), from 0.

    The parse result is only filtered *after* the outer explodes: a filter
    on the parse (or the one Spark infers for a plain ``explode``) would be
    pushed below the projection and re-evaluate the whole parse.
    """
    parsed = parse_staged(spread(df.select(*keys, text_col)), keys, text_col)
    rows = parsed.select(*keys, "_h", F.posexplode_outer("_rows").alias("row_no", "_r"))
    cells = rows.select(*keys, "row_no", F.posexplode_outer(
        F.arrays_zip(F.col("_h").alias("n"), F.col("_r").alias("v"))).alias("col_no", "_c"))
    return cells.where(F.col("row_no").isNotNull() & F.col("col_no").isNotNull()) \
        .select(*keys, "row_no", "col_no", F.col("_c.n").alias("col_name"), F.col("_c.v").alias("cell"))


def header_expr(text) -> Column:
    """Header cells of the first table (null without one); reads only its first line."""
    t = F.col(text) if isinstance(text, str) else text
    start = F.locate("| ", t)
    first = F.substring_index(F.substring(t, start, F.lit(2147483647)), "\n", 1)
    return F.when(start > 0, _cells(first))


def markdown_history(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                     text_col: str = "text") -> DataFrame:
    """Tables of all turns of a conversation, unioned (TAB2).

    Columns are the union of the tables' headers in first-seen order (by
    turn, then position in the header); a row gets ``''`` where its own table
    lacks a column.  Texts without a table, and null texts, are skipped.

    Two passes.  Pass 1 reads only each table's header line and finds the
    first (turn, position) per (conversation, column) with ``min`` /
    ``min_by`` (partial hash aggregates), then a per-conversation list,
    bounded by the number of distinct columns.  Pass 2 joins every parsed
    row to that list (one small row per conversation: broadcast when small,
    and AQE splits a skewed partition otherwise) and expands the row through
    a ``name -> cell`` map.

    Output long form: ``conv, turn, row_no, col_no, col_name, cell``.
    """
    turns = spread(turns.select(conv, turn, text_col))
    heads = turns.select(conv, turn, _dedupe_names(header_expr(text_col)).alias("_h"))
    first_seen = (heads.select(conv, turn, F.posexplode_outer("_h").alias("_i", "col_name"))
                  .where(F.col("col_name").isNotNull())
                  .groupBy(conv, "col_name").agg(F.min(turn).alias("_ft"), F.min_by("_i", turn).alias("_fi")))
    columns = (first_seen.groupBy(conv)
               .agg(F.transform(F.array_sort(F.collect_list(F.struct("_ft", "_fi", "col_name"))),
                                lambda s: s["col_name"]).alias("_cols")))
    parsed = parse_staged(turns, [conv, turn], text_col)
    rows = (parsed.select(conv, turn, _dedupe_names(F.col("_h")).alias("_h"),
                          F.posexplode_outer("_rows").alias("row_no", "_r"))
            .where(F.col("row_no").isNotNull()))
    cols = columns.withColumnRenamed(conv, "_conv")
    joined = rows.join(cols, rows[conv].eqNullSafe(cols["_conv"])).drop("_conv")   # null id: one group
    cellmap = F.map_from_arrays(F.col("_h"), F.col("_r"))
    dense = joined.select(conv, turn, "row_no", F.posexplode(F.transform(
        "_cols", lambda c: F.struct(c.alias("n"), F.coalesce(F.try_element_at(cellmap, c), F.lit("")).alias("v"))))
        .alias("col_no", "_c"))
    return dense.select(conv, turn, "row_no", "col_no", F.col("_c.n").alias("col_name"), F.col("_c.v").alias("cell"))


def table_from_chat(turns: DataFrame, method: str, conv: str = "conv_id", turn: str = "turn",
                    role: str = "role", text_col: str = "text", ai: str = "assistant") -> DataFrame | None:
    """Extractor choice of the Batch tab (PRJ15).

    ``"Markdown Table"``: the last turn's table (long form) with a ``Skip``
    column; ``"Chat History"``: ``(Input, Output)`` pairs; ``"History w/
    Tables"``: the unioned tables; anything else: ``None``.  Tables are only
    read from the answers, never from what the user wrote.
    """
    from .chat import chat_pairs, last_turn

    if method == "Markdown Table":
        last = last_turn(turns.where(F.col(role) == ai), conv, turn, text_col, out=text_col)
        return markdown_cells(last, [conv], text_col).select(F.lit("").alias("Skip"), "*")
    if method == "Chat History":
        return chat_pairs(turns, conv, turn, role, text_col)
    if method == "History w/ Tables":
        return markdown_history(turns.where(F.col(role) == ai), conv, turn, text_col)
    return None
