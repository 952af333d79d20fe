"""Operator 2: near-duplicates by MinHash with tensored banding.

Two collections of ``GROUPS`` groups of ``ROWS`` minhashes each give ``GROUPS**2``
tables: table (i, j) is keyed by group i of the first and group j of the second
collection.  So 32 minhashes serve 64 tables of four minhashes, about the square
root of what independent tables need.  Two texts of similarity 0.8 share a table with
probability ``(1 - (1 - 0.8**ROWS)**GROUPS)**2 = 0.9994``, and most share many.

1. Rows with the same shingle set are one class; its first row stands for it.
2. In every table each bucket links its members to its pivot, the first in one
   order of all rows (a star, never all pairs), and each link is confirmed on the full
   sets; after the first tables, only links across components are looked at, and buckets
   still in several components get other pivots for a few turns.
3. Buckets whose members besides the pivot are still in several components are not
   given up: those meet in an exact prefix join.  With the shingles in one global
   order (rare ones first, by a sketch of fixed size; any order is exact), two sets
   of similarity t share a shingle among the first ``n - ceil(t n) + 1``.  Only pairs
   across components are made; a positional bound and a parity bitmap, both exact,
   leave out pairs that cannot be similar enough, and the others are confirmed the same way.

Defined results: a text without a word (or null) has no shingle and no link; a
text with fewer words than a shingle has one, of all its words; repeated rows
are one class; null ids sort last, so a component's id is null only if all its ids
are; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptframe.session import ship_package

from .blocks import mix, ranges, signed, text_blocks, words
from .common import components, materialise, numbered, quoted

WORDS = 4
PERCENT = 80
GROUPS, ROWS = 8, 2
_RNG = np.random.Generator(np.random.PCG64(77))
_FLIP = _RNG.integers(0, 1 << 63, 2 * GROUPS * ROWS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, 2 * GROUPS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Counters of the shingle frequency sketch: at most this many rows reach the driver.
SKETCH = 1 << 18
#: Bits of the parity bitmap that bounds two sets' difference from below.
PARITIES = 1024
#: Orders that give the buckets still in several components another pivot.
TURNS = 4
#: A pair that shares one of so many shingles just before another common one has met there already.
BEFORE = 8


def shingle_sets(column: pa.Array, size: int):
    """Yield (row, sorted distinct 64-bit shingle hashes)."""
    for first, flat, starts in text_blocks(column):
        _, _, h, at = words(flat, starts)
        parts = np.zeros(max(len(h) - size + 1, 0), np.uint64)
        for i in range(size):
            parts = parts * _STEP + h[i:i + len(parts)]
        parts = mix(parts + np.uint64(size))
        for row in range(len(starts) - 1):
            lo, hi = int(at[row]), int(at[row + 1])
            if hi - lo >= size:
                yield first + row, np.unique(parts[lo:hi - size + 1])
            elif hi > lo:
                one = np.zeros(1, np.uint64)
                for w in h[lo:hi]:
                    one = one * _STEP + w
                yield first + row, mix(one + np.uint64(hi - lo))
            else:
                yield first + row, np.zeros(0, np.uint64)


def _parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls into each of ``PARITIES`` classes, as longs."""
    odd = np.bincount((shingles >> np.uint64(40) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(len(_FLIP), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 1 << 15):
        np.minimum(out, ((shingles[i:i + (1 << 15), None] ^ _FLIP) * _TIMES).min(axis=0), out=out)
    return out


def group_hashes(shingles: np.ndarray) -> np.ndarray:
    """The 2 * GROUPS group hashes: first collection, then second."""
    m = minhashes(shingles).reshape(-1, ROWS)
    out = np.arange(len(m), dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * _STEP + m[:, r])
    return out


def _signatures(size: int):
    def run(batches):
        for batch in batches:
            n, a, b, groups = [], [], [], []
            for _, s in shingle_sets(batch.column(2), size):
                n.append(len(s))
                a.append(int(np.add.reduce(s, dtype=np.uint64).view(np.int64)))
                b.append(int(np.add.reduce(mix(s + _STEP), dtype=np.uint64).view(np.int64)))
                groups.append(signed(group_hashes(s)) if len(s) else None)
            yield pa.RecordBatch.from_pydict({
                "rid": batch.column(0), "doc_id": batch.column(1), "n": pa.array(n, pa.int64()),
                "k1": pa.array(a, pa.int64()), "k2": pa.array(b, pa.int64()),
                "groups": pa.array(groups, pa.list_(pa.int64()))})
    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            found = [s.tobytes() for _, s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_pydict({"rid": batch.column(0), "shingles": pa.array(found, pa.binary())})
    return run


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def _prefix_pairs(open_docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs across components by an exact prefix join over ``open_docs`` (rid, label)."""
    rows = materialise(open_docs.join(sets, "rid"), "minhash-open")
    mask = np.uint64(SKETCH - 1)

    def count(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for s in batch.column(0):
                np.add.at(total, (np.frombuffer(s.as_buffer(), np.uint64) & mask).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at), "n": pa.array(total[at])})

    often = np.zeros(SKETCH, np.int64)
    for slot, n in (rows.select("shingles").mapInArrow(count, "slot long, n long")
                    .groupBy("slot").agg(F.sum("n")).collect()):  # at most SKETCH rows
        often[slot] = n
    shared = rows.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches):
        for batch in batches:
            rid, label, n, at, token, bits, before, known = [], [], [], [], [], [], [], []
            for r, c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                s = s[np.lexsort((s, shared.value[(s & mask).astype(np.int64)]))]
                size = len(s) - -(-percent * len(s) // 100) + 1
                token.append(signed(s[:size].copy()))
                known.append(np.minimum(np.arange(size), BEFORE))
                before.append(token[-1][ranges(np.arange(size) - known[-1], known[-1])])
                rid += [r] * size
                label += [c] * size
                n += [len(s)] * size
                at += range(size)
                bits += [_parities(s)] * size
            yield pa.RecordBatch.from_pydict({
                "rid": pa.array(rid, pa.int64()), "label": pa.array(label, pa.int64()), "n": pa.array(n, pa.int64()),
                "at": pa.array(at, pa.int64()), "bits": pa.array(bits, pa.list_(pa.int64())),
                "before": pa.ListArray.from_arrays(
                    np.concatenate([[0], *known]).cumsum().astype(np.int32),
                    np.concatenate(before) if before else np.zeros(0, np.int64)),
                "token": pa.array(np.concatenate(token) if token else np.zeros(0, np.int64))})

    index = materialise(rows.select("rid", "label", "shingles").mapInArrow(
        prefixes, "rid long, label long, n long, at long, bits array<long>, before array<long>, token long"), "minhash-prefix")
    mixed = index.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    index = index.join(mixed.select("token"), "token")
    x, y = index.alias("x"), index.alias("y")
    # Before this shingle at most min(at) are shared, after it at most as many as both have left.
    most = (F.least("x.at", "y.at") + 1
            + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) - 1)
    # Every shingle of one set alone flips one parity, so the differing parities are at most those shingles.
    flips = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(PARITIES // 64)),
                F.lit(0))
    near = ((F.col("x.label") < F.col("y.label"))
            & (100 * most >= percent * (F.col("x.n") + F.col("y.n") - most))
            & (flips * (100 + percent) <= (100 - percent) * (F.col("x.n") + F.col("y.n")))
            # A pair that shares one of the shingles just before meets there: similar ones meet at their first common one.
            & ~F.arrays_overlap(F.col("x.before"), F.col("y.before")))
    return (x.join(y, (F.col("x.token") == F.col("y.token")) & near)
            .select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct())


def _labelled(rows: DataFrame, col: str, labels: DataFrame) -> DataFrame:
    """``rows`` with the component of ``col`` (itself if it has no link) as ``<col>_label``."""
    own = labels.select(F.col("node").alias(col), F.col("label").alias("__label"))
    return (rows.join(own, col, "left").withColumn(f"{col}_label", F.coalesce("__label", col)).drop("__label"))


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: rid (the row's number), doc_id, n_shingles, component_id, kept, first (one row of each component).

    ``docs`` must be a table read from Parquet files (see :func:`numbered`).
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = numbered(docs, "rid", doc_id=F.col(quoted(id_col)).cast("long"), text=F.col(quoted(text_col)))
    marks = materialise(rows.mapInArrow(
        _signatures(size), "rid long, doc_id long, n long, k1 long, k2 long, groups array<long>"), "minhash-marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    classes = materialise(marks.where("n > 0").groupBy("n", "k1", "k2").agg(first.alias("first")), "minhash-classes")
    heads = materialise(marks.select("rid", "groups").join(classes.select(F.col("first.rid").alias("rid")), "rid"),
                        "minhash-heads")

    keys = F.expr(f"""flatten(transform(slice(groups, 1, {GROUPS}), (x, i) ->
                      transform(slice(groups, {GROUPS + 1}, {GROUPS}), (y, j) ->
                      named_struct('key', xxhash64(x, y), 'first', i = j))))""")
    table = heads.select("rid", F.explode(keys).alias("k")).select("rid", "k.key", "k.first")
    # One order of all rows gives a large group few pivots, the same in most of its buckets.
    buckets = (table.groupBy("key").agg(F.min(F.struct(F.xxhash64("rid").alias("h"), "rid")).alias("pivot"),
                                        F.count(F.lit(1)).alias("members"))
               .where("members > 1").select("key", F.col("pivot.rid").alias("pivot")))
    members = materialise(table.join(buckets, "key"), "minhash-members")
    involved = members.select("rid").distinct()
    sets = materialise(rows.select("rid", "text").join(involved, "rid").select("rid", "text").mapInArrow(
        _sets(size), "rid long, shingles binary"), "minhash-sets")

    def stars(found: DataFrame) -> DataFrame:
        return found.where("rid != pivot").select(
            F.least("rid", "pivot").alias("a"), F.greatest("rid", "pivot").alias("b")).distinct()

    # First the stars of GROUPS tables join most of what belongs together; of the others only links across are left.
    edges = materialise(_confirm(stars(members.where("first")), sets, percent), "minhash-edges")
    labels = components(edges)
    across = _labelled(_labelled(members.where("not first"), "rid", labels), "pivot", labels)
    rest = materialise(_confirm(stars(across.where("rid_label != pivot_label")), sets, percent), "minhash-edges")
    edges = edges.union(rest)
    labels = components(edges)

    # Further pivots in other orders, for buckets still in several components: each links most of what is left across.
    for turn in range(1, TURNS + 1):
        own = _labelled(members.select("key", "rid"), "rid", labels)
        pivots = (own.groupBy("key").agg(F.min("rid_label").alias("lo"), F.max("rid_label").alias("hi"),
                                         F.min(F.struct(F.xxhash64(F.lit(turn), "rid").alias("h"), "rid",
                                                        F.col("rid_label").alias("label"))).alias("p"))
                  .where("lo < hi").select("key", F.col("p.rid").alias("pivot"), F.col("p.label").alias("pivot_label")))
        across = own.join(pivots, "key").where("rid_label != pivot_label")
        found = materialise(_confirm(stars(across), sets, percent), "minhash-edges")
        if found.isEmpty():
            break
        edges = edges.union(found)
        labels = components(edges)

    # A bucket's first pivot has met all its members; what is left are pairs of other members across components.
    others = materialise(_labelled(members.where("rid != pivot").select("key", "rid"), "rid", labels),
                         "minhash-others")
    several = (others.groupBy("key").agg(F.min("rid_label").alias("lo"), F.max("rid_label").alias("hi"))
               .where("lo < hi").select("key"))
    open_docs = others.join(several, "key").select("rid", F.col("rid_label").alias("label")).distinct()
    more = materialise(_confirm(_prefix_pairs(open_docs, sets, percent), sets, percent), "minhash-more")
    if not more.isEmpty():
        labels = components(edges.union(more))

    heads_of = (classes.select("n", "k1", "k2", F.col("first.rid").alias("head"), F.col("first").alias("first"))
                .join(labels, F.col("head") == F.col("node"), "left")
                .withColumn("label", F.coalesce("label", "head")).drop("node"))
    lowest = heads_of.groupBy("label").agg(F.min("first").alias("lowest"))
    heads_of = heads_of.join(lowest, "label").select("n", "k1", "k2", "lowest")
    out = marks.select("rid", "doc_id", "n", "k1", "k2").join(heads_of, ["n", "k1", "k2"], "left")
    component = F.when(F.col("lowest").isNull(), F.col("doc_id")).otherwise(F.col("lowest.doc_id"))
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
                      F.coalesce(F.col("rid") == F.col("lowest.rid"), F.lit(True)).alias("first"))
