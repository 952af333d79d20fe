"""Operator 9: exact substring deduplication by distributed prefix doubling.

A suffix array by prefix doubling ranks every position by its first h bytes and
then doubles h by pairing a position's rank with the one h further on; for
finding repeats, a position is done once its rank is unique or h has passed the
threshold.  Here the rank of a string is its 64-bit fingerprint (equal strings,
equal ranks, at any place), so a pair of ranks needs no lookup, and Spark only has to
bring equal pairs together and rerank what is not unique:

1. *Sampled positions.*  Of every ``LENGTH - FIRST`` neighbouring positions the one with
   the smallest fingerprint of ``GRAM`` bytes is an anchor; equal strings have equal
   anchors, so every window of ``LENGTH`` bytes has its anchor in it, at the same place as its
   copies.  Anchors start with their rank for ``FIRST`` bytes; those with a
   unique one drop out, with all windows they stand for.
2. The others are paired with the rank of the bytes that follow, up to ``LENGTH``.  A pair
   that occurs again covers its bytes; neighbouring anchors cover all but the edges of a
   repeat.
3. *Edges.*  Windows that reach beyond what is covered, and the windows at the same places
   of the anchors with the same rank elsewhere, are taken ``CELL`` places at a time: a
   cell whose common core has a unique rank drops out, one whose whole extent occurs
   again is covered, by pairs again.
4. Only in cells where a repeat ends is every position ranked by itself.

The result equals ranking all positions, at a fraction of the rows.

Defined results: a null text is empty; a text shorter than ``LENGTH`` bytes loses
nothing; repeated rows are copies of one another; a null id is kept as it is;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptframe.session import ship_package

from .blocks import byte_prefix_sums, merged, pack, ranges, signed, sliding_min, span_hash, text_blocks, unpack
from .common import drop_table, materialise, numbered, quoted

LENGTH = 200
FIRST = 64
GRAM = 16
CELL = 16


def _list(values: list[np.ndarray], kind) -> pa.Array:
    return pa.array(np.concatenate(values) if values else np.zeros(0, kind))


def _anchors(length: int):
    span = length - FIRST + 1

    def run(batches):
        for batch in batches:
            rids = batch.column(0).to_numpy()
            for row, flat, starts in text_blocks(batch.column(1)):
                size = np.diff(starts)
                window = ranges(starts[:-1], np.maximum(size - length + 1, 0))
                if not len(window):
                    continue
                sums = byte_prefix_sums(flat)
                at = np.arange(len(flat) - GRAM + 1)
                key = (span_hash(sums, at, at + GRAM) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
                anchor = (sliding_min(key, span)[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
                run_start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
                run_end = np.append(run_start[1:], len(anchor)) - 1
                p = anchor[run_start]
                doc = np.searchsorted(starts, p, "right") - 1
                begin = starts[doc]
                whole = p + length <= starts[doc + 1]
                after = span_hash(sums, np.where(whole, p + FIRST, 0), np.where(whole, p + length, 0))
                yield pa.RecordBatch.from_pydict({
                    "rid": pa.array(rids[row + doc]), "pos": pa.array(p - begin),
                    "lo": pa.array(window[run_start] - begin), "hi": pa.array(window[run_end] - begin),
                    "r1": pa.array(signed(span_hash(sums, p, p + FIRST))),
                    "r2": pa.array(signed(after), mask=~whole)})
    return run


def _open_ranges(length: int):
    """Per document: each anchor's places (anchor minus window start) that reach beyond what is covered."""
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("rid", "pos", "lo", "hi", "r1", "near", "far", "full")}
            for rid, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                f = found.values
                pos, lo, hi = (f.field(c).to_numpy() for c in ("pos", "lo", "hi"))
                full = f.field("full").to_numpy(zero_copy_only=False)
                covered = pos[full]
                start, end = merged(covered, covered + length)
                window = ranges(lo, hi - lo + 1)
                place = np.repeat(pos, hi - lo + 1) - window
                if len(start):
                    i = np.searchsorted(start, window, "right") - 1
                    beyond = (i < 0) | (end[i] < window + length)
                else:
                    beyond = np.ones(len(window), bool)
                first = np.cumsum(hi - lo + 1) - (hi - lo + 1)
                out["near"].append(np.minimum.reduceat(np.where(beyond, place, 1 << 40), first))
                out["far"].append(np.maximum.reduceat(np.where(beyond, place, -1), first))
                out["rid"].append(np.full(len(pos), rid))
                for c, v in (("pos", pos), ("lo", lo), ("hi", hi), ("r1", f.field("r1").to_numpy()), ("full", full)):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict({k: _list(v, bool if k == "full" else np.int64) for k, v in out.items()})
    return run


def _cells(length: int):
    """Rank pairs of the asked-for cells of each document.

    A cell is ``CELL`` neighbouring places of an anchor.  Its core is what all its windows
    share, its whole what they cover together (null at a document's edge).
    """
    def run(batches):
        for batch in batches:
            rids, asked = batch.column(0).to_numpy(), batch.column(2)
            for row, flat, starts in text_blocks(unpack(batch.column(1))):
                sums = byte_prefix_sums(flat)
                lists = [asked[row + i].values for i in range(len(starts) - 1)]
                size = [len(f) for f in lists]
                pos, lo, hi, first, last, near, far = (
                    np.concatenate([f.field(c).to_numpy() for f in lists])
                    for c in ("pos", "lo", "hi", "first", "last", "near", "far"))
                doc = np.repeat(np.arange(len(size)), size)
                low, high = (pos - last) // CELL, (pos - first) // CELL
                n = high - low + 1
                cell = ranges(low, n)
                pos, lo, hi, near, far, doc = (np.repeat(v, n) for v in (pos, lo, hi, near, far, doc))
                begin = starts[doc]
                core = begin + pos - cell * CELL  # the window of the cell's first place starts here
                whole = core - (CELL - 1)
                inside = (whole >= begin) & (core + length <= starts[doc + 1])
                whole = np.where(inside, whole, core)
                stop = np.where(inside, core + length, core)
                yield pa.RecordBatch.from_pydict({
                    "rid": pa.array(rids[row + doc]),
                    "lo": pa.array(np.maximum(lo, pos - cell * CELL - CELL + 1)),
                    "hi": pa.array(np.minimum(hi, pos - cell * CELL)),
                    "start": pa.array(core - begin),
                    "r1": pa.array(signed(span_hash(sums, core, core + FIRST))),
                    "r2": pa.array(signed(span_hash(sums, core + FIRST, core + length - CELL + 1))),
                    "w1": pa.array(signed(span_hash(sums, whole, core)), mask=~inside),
                    "w2": pa.array(signed(span_hash(sums, core, stop)), mask=~inside),
                    "mine": pa.array((cell * CELL <= far) & (cell * CELL + CELL - 1 >= near))})
    return run


def _windows(length: int):
    """Rank pairs of the asked-for windows of each document, with their place where the document itself needs to know."""
    def run(batches):
        for batch in batches:
            rids, asked = batch.column(0).to_numpy(), batch.column(2)
            for row, flat, starts in text_blocks(unpack(batch.column(1))):
                sums = byte_prefix_sums(flat)
                lists = [asked[row + i].values for i in range(len(starts) - 1)]
                doc = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
                lo, hi, mine = (np.concatenate([f.field(c).to_numpy(zero_copy_only=False) for f in lists])
                                for c in ("lo", "hi", "mine"))
                n = hi - lo + 1
                window, doc, mine = ranges(lo, n), np.repeat(doc, n), np.repeat(mine, n)
                at = window + starts[doc]
                yield pa.RecordBatch.from_pydict({
                    "rid": pa.array(rids[row + doc], mask=~mine), "pos": pa.array(window, mask=~mine),
                    "r1": pa.array(signed(span_hash(sums, at, at + FIRST))),
                    "r2": pa.array((span_hash(sums, at + FIRST, at + length) >> np.uint64(32)).astype(np.uint32)
                                   .view(np.int32))})
    return run


def _again(rows: DataFrame, *rank: str) -> DataFrame:
    """The ranks that occur more than once."""
    return rows.groupBy(*rank).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*rank)


def _removed(length: int, with_text: bool):
    def run(batches):
        for batch in batches:
            size, gone, spans, digest, texts = [], [], [], [], []
            found = batch.column(3)
            for row, flat, starts in text_blocks(unpack(batch.column(2))):
                for i in range(len(starts) - 1):
                    raw = flat[starts[i]:starts[i + 1]]
                    f = found[row + i].values
                    start, end = (np.zeros(0, np.int64),) * 2
                    if f is not None and len(f):
                        start, end = merged(f.to_numpy(), f.to_numpy() + length)
                    keep = np.ones(len(raw), bool)
                    for a, b in zip(start, end):
                        keep[a:b] = False
                    left = raw[keep].tobytes() if len(start) else raw.tobytes()
                    size.append(len(raw))
                    gone.append(len(raw) - len(left))
                    spans.append(len(start))
                    digest.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        texts.append(left.decode("utf-8", "replace"))
            cols = {"rid": batch.column(0), "doc_id": batch.column(1), "n_bytes": pa.array(size, pa.int64()),
                    "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
                    "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                cols["kept_text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(cols)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """Per row: rid (the row's number), doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text).

    ``docs`` must be a table read from Parquet files (see :func:`numbered`).
    """
    if length <= FIRST + GRAM + CELL:
        raise ValueError(f"length must be over {FIRST + GRAM + CELL}")
    ship_package(docs.sparkSession)
    rows = numbered(docs, "rid", doc_id=F.col(quoted(id_col)).cast("long"), text=F.col(quoted(text_col)))
    texts = rows.select("rid", "text")
    packed = texts.mapInArrow(pack, "rid long, packed binary")

    # Round 1: ranks of FIRST bytes at the anchors; unique ones drop out.
    anchors = texts.mapInArrow(_anchors(length), "rid long, pos long, lo long, hi long, r1 long, r2 long")
    anchors_1 = anchors = materialise(anchors.join(_again(anchors, "r1"), "r1"), "doubling-1")

    # Round 2: pairs of ranks up to ``length`` bytes.
    pairs = _again(anchors.where("r2 is not null"), "r1", "r2").withColumn("full", F.lit(True))
    anchors = anchors.join(pairs, ["r1", "r2"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
    found_rows = F.collect_list(F.struct("pos", "lo", "hi", "r1", "full")).alias("found")
    edges = anchors.groupBy("rid").agg(found_rows).mapInArrow(
        _open_ranges(length), "rid long, pos long, lo long, hi long, r1 long, near long, far long, full boolean")
    edges = materialise(edges, "doubling-2")
    drop_table(anchors_1)

    # Round 3: cells of places at the edges, and the same places of the anchors of the same rank.
    wanted = (edges.where("far >= 0").groupBy("r1")
              .agg(F.min("near").alias("want_near"), F.max("far").alias("want_far")))
    asked = (edges.join(wanted, "r1")
             .withColumn("first", F.greatest("lo", F.col("pos") - F.col("want_far")))
             .withColumn("last", F.least("hi", F.col("pos") - F.col("want_near"))).where("first <= last")
             .groupBy("rid").agg(F.collect_list(
                 F.struct("first", "last", "near", "far", "pos", "lo", "hi")).alias("asked")))
    cells_3 = cells = materialise(packed.join(asked, "rid").select("rid", "packed", "asked").mapInArrow(
        _cells(length), "rid long, lo long, hi long, start long, r1 long, r2 long, w1 long, w2 long, mine boolean"),
        "doubling-3")
    # Two anchors of a text may stand for the same extent: another place must have it.
    place = F.struct("rid", "start")
    wholes = (cells.where("w1 is not null").groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b"))
              .where("a < b").select("w1", "w2", F.lit(True).alias("full")))
    cells = (cells.join(_again(cells, "r1", "r2"), ["r1", "r2"]).join(wholes, ["w1", "w2"], "left")
             .withColumn("full", F.coalesce("full", F.lit(False))).drop("w1", "w2"))
    cells = materialise(cells, "doubling-4")
    drop_table(cells_3)
    ends = F.explode(F.array(F.col("start"), F.col("start") - (CELL - 1))).alias("pos")
    covered = materialise(edges.where("full").select("rid", "pos").union(cells.where("full").select("rid", ends)),
                          "doubling-covered")
    drop_table(edges)

    # Round 4: single positions in the cells where a repeat ends.
    wanted = cells.where("mine and not full").select("r1", "r2").distinct()
    asked = (cells.join(wanted, ["r1", "r2"])
             .groupBy("rid").agg(F.collect_list(
                 F.struct("lo", "hi", F.expr("mine and not full").alias("mine"))).alias("asked")))
    windows = materialise(packed.join(asked, "rid").select("rid", "packed", "asked").mapInArrow(
        _windows(length), "rid long, pos long, r1 long, r2 int"), "doubling-5")
    twice = _again(windows, "r1", "r2")
    found = covered.union(windows.where("rid is not null").join(twice, ["r1", "r2"]).select("rid", "pos"))

    found = materialise(found.groupBy("rid").agg(F.collect_list("pos").alias("found")), "doubling-found")
    schema = "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    ids = rows.select("rid", "doc_id", "text").mapInArrow(
        lambda batches: pack(batches, ("rid", "doc_id")), "rid long, doc_id long, packed binary")
    return (ids.join(found, "rid", "left").select("rid", "doc_id", "packed", "found")
            .mapInArrow(_removed(length, with_text), schema + ", kept_text string" * with_text))
