"""Positions under repeated, null and hot keys: gapless, in order, in even partitions, the input read at most twice."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from promptframe.operators import positional as P


def _gapless(df, n):
    got = sorted(df.collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(n))
    return got


def test_hot_null_and_repeated_keys(spark):
    rnd = random.Random(3)
    data = [(rnd.choice([None, 1, 1, 1, 2, rnd.randint(3, 50)]), i) for i in range(6000)] + [(1, -1)] * 3000
    df = spark.createDataFrame(data, "k int, v int").repartition(6)
    got = _gapless(P.with_pos(df, "k", num_partitions=16), 9000)
    assert [r["k"] for r in got] == sorted((k for k, _ in data), key=lambda k: (k is not None, k or 0))
    assert sorted((r["k"] is None, r["k"] or 0, r["v"]) for r in got) == sorted((k is None, k or 0, v) for k, v in data)
    # A third of the rows are equal and half share a key: still no partition holds over twice its share.
    table = P._Ordered(df, ["k"], 16)
    assert table.total == 9000 and len(table.files) == 16 and max(n for _, _, n in table.files) < 2 * 9000 / 16
    assert [r["k"] for r in _gapless(table.positions("pos"), 9000)] == [r["k"] for r in got]


def test_positions_repeat_where_rows_differ(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "k int, v int")
    a, b = (P.with_pos(df.repartition(n), "k").select("pos", "v") for n in (3, 5))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_sort_expressions_names_and_types(spark):
    df = spark.range(300).select(F.col("id").alias("a.b"), F.lit(None).alias("void"), F.create_map(F.lit("x"), "id").alias("m"),
                                 F.array("id").alias("c0"), F.lit("q").alias("_metadata"), F.lit(1).alias("odd , name;"))
    got = _gapless(P.with_pos(df, F.col("`a.b`").desc()), 300)
    assert [r["a.b"] for r in got] == list(range(299, -1, -1)) and got[0]["m"] == {"x": 299}
    assert P.with_pos(df, "a.b").columns == ["pos", *df.columns]
    assert P.with_pos(df, "a.b").schema["void"].dataType.simpleString() == "void"
    assert P.with_pos(df.limit(0), "a.b").count() == 0 and P.slice_rows(df.limit(0), 0, 5, "a.b").count() == 0


def test_the_input_is_read_at_most_twice(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            calls.add(len(f))
            yield f

    df = spark.range(4000).select((F.col("id") * 7919 % 4001).alias("k")).mapInPandas(count, "k long")
    out, n = P.with_pos(df, "k", num_partitions=9, return_count=True)
    assert n == 4000 and out.count() == 4000 and len(out.where("pos < 10").collect()) == 10
    assert calls.value <= 2 * 4000
    before = calls.value
    assert [r["pos"] for r in P.slice_rows(df, 100, 107, "k").orderBy("pos").collect()] == list(range(100, 107))
    assert calls.value - before <= 2 * 4000


def test_a_slice_reads_the_files_it_overlaps(spark):
    table = P._Ordered(spark.range(5000).withColumnRenamed("id", "k"), ["k"], 20)
    part = table.positions("pos", 1200, 1300)
    assert sorted(r["k"] for r in part.collect()) == list(range(1200, 1300))
    held = [f for f, at, n in table.files if at < 1300 and at + n > 1200]
    assert len(held) <= 3 and all(f in part._jdf.queryExecution().optimizedPlan().toString() for f in held)
