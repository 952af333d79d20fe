"""LLM maps over tables (LLM1-LLM3, LLM2 chains, AGG5 call accounting).

The prompt is built by Catalyst (templates compile to ``concat``), so only
the rows and columns that need a model call reach Python: filter and
``select`` before calling, since Catalyst cannot push filters below
``mapInPandas``.  Inside each task rows are cut into fixed-size batches; a
failing batch falls back to one call per row, and a failing row gets ``''``
with ``status='error'`` (``on_error='blank'``), or the job fails with the
batch range (``on_error='fail'``).  No shuffle is involved: parallelism is
the input's partitioning (``repartition(n)`` caps concurrent callers).

Side effects: a retried task repeats its calls.  Keep speculation off, and
persist the result (write it, or ``checkpoint``) before using it twice; to
resume after a failure, ``left_anti``-join the finished keys.
"""

from __future__ import annotations

import re
import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import literal_json
from ..session import ship_package, spread

RESULT_FIELDS = [T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
                 T.StructField("elapsed_ms", T.LongType())]


def _messages_of(v):
    if v is None:
        return [{"role": "human", "content": ""}]
    if isinstance(v, str):
        return [{"role": "human", "content": v}]
    return [{"role": m["role"], "content": m["content"]} for m in v]


def _run_batches(items, client, batch_size, on_error, first_index):
    n = len(items)
    out, status, error, elapsed = [""] * n, ["ok"] * n, [None] * n, [0] * n
    for i in range(0, n, batch_size):
        chunk = items[i:i + batch_size]
        t0 = time.perf_counter()
        try:
            res = client.batch(chunk)
            if len(res) != len(chunk):
                raise RuntimeError(f"client returned {len(res)} results for {len(chunk)} inputs")
            ms = int((time.perf_counter() - t0) * 1000)
            for j, r in enumerate(res):
                out[i + j], elapsed[i + j] = r, ms
        except Exception as e:  # noqa: BLE001 - classified below
            lo, hi = first_index + i, first_index + i + batch_size
            if on_error == "fail":
                raise RuntimeError(f"llm batch error: {e} at batch {lo} to {hi}") from e
            for j, item in enumerate(chunk):
                t1 = time.perf_counter()
                try:
                    out[i + j] = client.invoke(item)
                except Exception as e2:  # noqa: BLE001 - recorded per row
                    out[i + j], status[i + j], error[i + j] = "", "error", f"{type(e2).__name__}: {e2}"
                elapsed[i + j] = int((time.perf_counter() - t1) * 1000)
    return out, status, error, elapsed


def _mapper(input_col, out, client_opts, batch_size, on_error, kind):
    def run(batches):
        from promptframe.operators.clients import make_chat_client

        client = make_chat_client(client_opts)
        seen = 0
        for pdf in batches:
            if len(pdf) == 0:
                continue
            vals = pdf[input_col].tolist()
            items = [_messages_of(v) for v in vals] if kind == "chat" else ["" if v is None else v for v in vals]
            o, s, e, ms = _run_batches(items, client, batch_size, on_error, seen)
            seen += len(pdf)
            res = pdf.copy()
            res[out] = pd.Series(o, index=pdf.index, dtype=object)
            res["status"] = s
            res["error"] = pd.Series(e, index=pdf.index, dtype=object)
            res["elapsed_ms"] = pd.Series(ms, index=pdf.index, dtype="int64")
            yield res
    return run


def llm_map(df: DataFrame, input_col: str, client: dict, batch_size: int = 10, on_error: str = "blank",
            out: str = "Output", kind: str = "chat") -> DataFrame:
    """Call a model per row; adds ``out``, ``status``, ``error``, ``elapsed_ms``.

    ``input_col`` holds ``array<struct<role, content>>`` (or a plain string, a
    single human message) for ``kind='chat'``, or a JSON payload string for
    ``kind='chain'``.
    """
    if int(batch_size) < 1:
        raise ValueError("batch_size must be >= 1")
    if on_error not in ("blank", "fail"):
        raise ValueError("on_error must be 'blank' or 'fail'")
    ship_package(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name not in (out, "status", "error", "elapsed_ms")]
    schema = T.StructType(fields + [T.StructField(out, T.StringType())] + RESULT_FIELDS)
    src = df.select(*[F.col(f"`{f.name}`") for f in fields])
    if not df.isStreaming:
        src = spread(src)
    return src.mapInPandas(_mapper(input_col, out, client, int(batch_size), on_error, kind), schema)


def llm_batch(df: DataFrame, system_template: str, user_template: str, client: dict,
              history: list[tuple[str, str]] | None = None, start=None, end=None, order_by=None,
              batch_size: int = 10, on_error: str = "blank", keep: list[str] | None = None,
              out: str = "Output") -> DataFrame:
    """The Batch tab (LLM1): slice, skip, render, call, one output per row.

    ``keep`` limits the carried columns (default: all).  With ``start`` /
    ``end`` the rows are ranked by ``order_by`` first (positions need a key).
    Returns the kept columns + ``messages`` + ``Output`` + call status.
    """
    from .chat import chat_prompt
    from .positional import skip_filter, slice_rows

    rows = df
    if start is not None or end is not None:
        rows = slice_rows(rows, start, end, order_by, keep_pos=False)
    rows = skip_filter(rows)
    if keep is not None:
        from ..functions.template import placeholders

        need = set(placeholders(system_template)) | set(placeholders(user_template))
        rows = rows.select(*dict.fromkeys(list(keep) + sorted(need - set(keep))))
    prompted = chat_prompt(rows, system_template, user_template, history)
    return llm_map(prompted, "messages", client, batch_size, on_error, out)


def chain_batch(df: DataFrame, client: dict, start=None, end=None, order_by=None, batch_size: int = 10,
                out: str = "output") -> DataFrame:
    """LangServe-style chain over rows (LLM2).

    Columns named ``!x`` are parsed from JSON into ``x`` (never evaluated);
    each row becomes one JSON payload; any error fails the job, as the
    reference does.  Output: the message columns + ``output``.
    """
    from .positional import slice_rows

    rows = df
    if start is not None or end is not None:
        rows = slice_rows(rows, start, end, order_by, keep_pos=False)
    msg = bang_columns(rows)
    payload = msg.withColumn("__payload", F.to_json(F.struct(*[F.col(f"`{c}`") for c in msg.columns])))
    res = llm_map(payload, "__payload", client, batch_size, "fail", out, kind="chain")
    return res.drop("__payload", "status", "error", "elapsed_ms")


def bang_columns(df: DataFrame, error_col: str | None = None) -> DataFrame:
    """``!col`` -> ``col`` holding the value spelled in the cell, as JSON or as a Python literal (PRJ9, JS5).

    One parser turns every cell into canonical JSON (``functions.literals``); the value's type is the
    merge over *every* cell's canonical text, computed by one distributed aggregate (``schema_of_variant_agg``)
    for all ``!`` columns together, and the value is read from that same text.  Only the type string reaches the driver;
    it is written in the JSON reader's terms (objects as structs, non-integer numbers as doubles).
    Cells whose shapes conflict (an object here, a list there) or a column
    where nothing parses keep the value as a ``variant``.  Cells that do not
    parse give null, and ``error_col`` (if named) says why, as a map from column to message, null where all is well;
    nothing is ever evaluated as code.
    """
    bang = [c for c in df.columns if c.startswith("!")]
    if not bang:
        return df
    ship_package(df.sparkSession)
    read = df.select(*[(literal_json(F.col(f"`{c}`")) if c in bang else F.col(f"`{c}`")).alias(c) for c in df.columns])
    found = read.select(*[F.expr(f"schema_of_variant_agg(try_parse_json(`{c}`.json))") for c in bang]).first()
    types = {c: _json_ddl(t) for c, t in zip(bang, found)}
    out = [F.from_json(F.col(f"`{c}`.json"), types[c]).alias(c[1:]) if c in types else F.col(f"`{c}`") for c in df.columns]
    if error_col:
        wrong = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c[1:]).alias("k"), F.col(f"`{c}`.error").alias("v"))
                                                      for c in bang]), lambda e: e["v"].isNotNull()))
        out.append(F.when(F.size(wrong) > 0, wrong).alias(error_col))
    return read.select(*out)


def _json_ddl(variant_type: str | None) -> str:
    """A ``schema_of_variant`` type as a ``from_json`` schema ("variant" when there is none)."""
    if variant_type is None or variant_type in ("VOID", "VARIANT") or not variant_type.startswith(("OBJECT", "ARRAY")):
        return "variant"
    # Rewrite type names outside backtick-quoted field names only.
    parts = re.split(r"(`(?:[^`]|``)*`)", variant_type)
    for i in range(0, len(parts), 2):
        p = re.sub(r"\bOBJECT<", "STRUCT<", parts[i])
        p = re.sub(r"\bDECIMAL\(\d+,\s*\d+\)", "DOUBLE", p)
        parts[i] = re.sub(r"\bVOID\b", "STRING", p)
    return "".join(parts)


def call_stats(results: DataFrame) -> DataFrame:
    """Call accounting per status (AGG5): count, least and mean latency, p50/p95."""
    return results.groupBy("status").agg(
        F.count(F.lit(1)).alias("calls"), F.min("elapsed_ms").alias("min_ms"), F.avg("elapsed_ms").alias("avg_ms"),
        F.percentile_approx("elapsed_ms", [0.5, 0.95]).alias("p50_p95_ms"))
