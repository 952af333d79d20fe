"""Operator 10: sharding by a hierarchical weighted hash tree (native).

A layout is a tree of regions, racks and shards; every node weighs as many
shards as lie below it.  A row descends the tree: at each level every child
draws ``-ln(u) / weight`` from a hash of the row's key and the child's place in
the tree, and the smallest draw wins, so a child gets its share by weight, and a
change of one child's weight only moves rows out of or into that child's
subtree.  A grown shard joins as a region of its own: no other region's weight
changes, so rows move only into the new shard (law ``key``).

Defined results: a null key is placed by a hash of its text, so that null keys
don't meet in one shard; a null text has 0 bytes; repeated rows get one slot each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, number

SHARDS = 40
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 4

Layout = list[list[int]]


def layout(shards: int = SHARDS, racks: int = RACKS_PER_REGION, per_rack: int = SHARDS_PER_RACK) -> Layout:
    """``[[shards of rack 0, shards of rack 1, ...], ...]`` by region; the last ones may be smaller."""
    if shards < 1:
        raise ValueError("a layout needs a shard")
    full, rest = divmod(shards, per_rack)
    sizes = [per_rack] * full + ([rest] if rest else [])
    return [sizes[i:i + racks] for i in range(0, len(sizes), racks)]


def grow(tree: Layout) -> Layout:
    """The layout with one more shard, in a region of its own."""
    return [*tree, [1]]


def _pick(key: Column, place: list, weights: list[int]) -> Column:
    """Number of the winning child among ``weights``; ``place`` names the node."""
    if len(weights) == 1:
        return F.lit(0)
    draws = []
    for i, w in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, *[F.lit(p) for p in place], F.lit(i)), 12)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
        draws.append(F.struct((-F.log(u) / F.lit(float(w))).alias("d"), F.lit(i).alias("i")))
    return F.array_min(F.array(*draws)).getField("i")


def _choose(picked: Column, results: list[Column]) -> Column:
    out = results[-1]
    for i in range(len(results) - 2, -1, -1):
        out = F.when(picked == i, results[i]).otherwise(out)
    return out


def place(df: DataFrame, key: str, tree: Layout, name: str) -> DataFrame:
    """``df`` with the column ``name``: the shard that the tree gives to ``key``.

    Each level is a projection of its own, so a draw is written once.
    """
    k = F.col(key)
    flat = {(r, c): i for i, (r, c) in enumerate((r, c) for r, racks in enumerate(tree) for c in range(len(racks)))}
    first, at = [], 0
    for racks in tree:
        for size in racks:
            first.append(at)
            at += size
    region, rack = f"__{name}_region", f"__{name}_rack"
    df = df.withColumn(region, _pick(k, ["region"], [sum(r) for r in tree]))
    df = df.withColumn(rack, _choose(F.col(region), [
        _pick(k, ["rack", r], racks) + F.lit(flat[r, 0]) for r, racks in enumerate(tree)]))
    sizes = [size for racks in tree for size in racks]
    df = df.withColumn(name, _choose(F.col(rack), [
        _pick(k, ["shard", i], [1] * size) + F.lit(first[i]) for i, size in enumerate(sizes)]))
    return df.drop(region, rack)


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every row; see the module's text for nulls, ties and repeated rows.

    Returns the key, ``size`` (UTF-8 bytes plus 16), ``text_crc32``, ``law``,
    ``shard``, ``slot`` and ``grown_shard`` (the shard with one more in the layout).
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"),
                       (F.octet_length(raw) + 16).cast("long").alias("size"),
                       F.crc32(raw).alias("text_crc32"),
                       F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key))).otherwise(F.xxhash64(raw))
                       .alias("__key"))
    tree = layout(shards)
    placed = place(place(rows, "__key", tree, "shard"), "__key", grow(tree), "grown_shard")
    # Stored once: small rows without the text.  The row's number in the input tells repeated rows apart.
    placed = materialise(placed.withColumn("__spread", F.xxhash64(F.monotonically_increasing_id())), "shards")
    out = number(placed, "shard", ["doc_id", "size", "text_crc32"], "__spread", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
