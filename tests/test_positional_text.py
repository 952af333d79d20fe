"""Positional operators, templates, prompt markers and similarity guards."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promptframe.functions.template import placeholders, render
from promptframe.operators import positional as P
from promptframe.operators.metaprompt import detect_no_change, extract_updated_prompt, meta_result
from promptframe.operators.similarity import compare_strings, delta_similarities

from .conftest import rows


def test_with_pos_matches_global_order(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = P.with_pos(df, "k").select("pos", "k").orderBy("pos").collect()
    keys = sorted(r["k"] for r in df.collect())
    assert [r["k"] for r in got] == keys and [r["pos"] for r in got] == list(range(5000))


def test_slice_clamped_and_python_semantics(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [r["k"] for r in P.slice_rows(df, 7, 100, "k").orderBy("pos").collect()] == [7, 8, 9]
    assert P.slice_rows(df, 5, 2, "k").count() == 0
    assert P.slice_bounds(10, -3, None) == (7, 10)


def test_skip_rules(spark):
    df = spark.createDataFrame([(None, "Software QA"), (None, "Safeguard")], "Skip string, role string")
    assert P.skip_filter(df).count() == 2
    assert P.skip_filter(df, strict=True).count() == 0
    no_skip = spark.createDataFrame([("a",)], "x string")
    assert P.skip_filter(no_skip).count() == 1
    assert P.add_skip(no_skip).columns == ["Skip", "x"]
    assert P.add_skip(df).columns == ["Skip", "role"]


def test_merge_table_golden(spark):
    left = spark.createDataFrame([(1, "a", "e", ""), (2, "b", "f", "skip"), (3, "c", "g", ""), (4, "d", "h", "")],
                                 "k int, col1 string, col2 string, Skip string")
    out = spark.createDataFrame([(1, "out1"), (2, "out2")], "j int, output string")
    m = P.merge_positional(left, out, 0, 4, left_order="k", right_order="j").orderBy("pos").collect()
    assert [(r["col1"], r["output"]) for r in m] == [("a", "out1"), ("c", "out2"), ("d", None)]


def test_add_index_and_fields(spark):
    df = spark.createDataFrame([("hello",), ("world",)], "text string")
    got = P.add_index(df, "text").orderBy("index").collect()
    assert [(r["index"], r["text"]) for r in got] == [(0, "hello"), (1, "world")]
    assert P.project_fields(spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"), " c , a").columns == ["c", "a"]


def test_zip_count_check(spark):
    a = spark.createDataFrame([(1,), (2,)], "v int")
    b = spark.createDataFrame([(1,)], "m int")
    with pytest.raises(ValueError):
        P.zip_positional(a, b, "v", "m")


def test_batch_ids_and_union_fill(spark):
    b = P.batch_ids(spark.range(25).withColumnRenamed("id", "k"), 10, "k")
    assert rows(b.groupBy("batch_id").count()) == [(0, 10), (1, 10), (2, 5)]
    with pytest.raises(ValueError):
        P.batch_ids(spark.range(3), 0)
    u = P.union_fill(spark.createDataFrame([("1", "2")], "C1 string, C2 string"),
                     spark.createDataFrame([("3", "4")], "C1 string, C3 string"))
    assert u.columns == ["C1", "C2", "C3"] and rows(u) == [("1", "2", ""), ("3", "", "4")]


def test_template(spark):
    df = spark.createDataFrame([("QA", None)], "role string, other string")
    assert df.select(render("You are a {role}. {{literal}} {other}")).first()[0] == "You are a QA. {literal} "
    assert placeholders("{a} {b} {a}") == ["a", "b"]
    with pytest.raises(ValueError):
        placeholders("{a!r}")


def test_prompt_markers(spark):
    df = spark.createDataFrame([
        ("x <!-- BEGIN OF PROMPT -->You are an expert assistant.<!-- END OF PROMPT --> y",),
        ("<!-- BEGIN OF PROMPT -->\n```\nYou are an expert assistant.\n```\n<!-- END OF PROMPT -->",),
        ("no markers",), ("fine <!-- NO CHANGE TO PROMPT -->",)], "r string")
    got = [tuple(r) for r in df.select(extract_updated_prompt("r"), detect_no_change("r")).collect()]
    assert got[0] == ("You are an expert assistant.", False)
    assert got[1] == ("\nYou are an expert assistant.\n", False)
    assert got[2] == (None, False) and got[3] == (None, True)
    res = meta_result(df.withColumnRenamed("r", "response")).collect()
    assert res[3]["changed"] is False and res[3]["new_prompt"] == "fine <!-- NO CHANGE TO PROMPT -->"


def test_similarity_guards(spark):
    df = spark.createDataFrame([(0, "", "", "x"), (1, "", "beta", "x"), (2, "alpha", "", "x"), (3, "same", "same", "x"),
                                (4, "the cat sat", "a dog ran", "the cat sat down")],
                               "id int, alpha string, beta string, expected string")
    d = dict(rows(delta_similarities(df, "id")))
    c = dict(rows(compare_strings(df, "id")))
    assert (d[0], d[1], d[2], d[3]) == (0.0, -1.0, 1.0, 0.0)
    assert (c[0], c[1], c[2], c[3]) == (None, "B", "A", None)
    # tokens of 2+ chars: the, cat, sat vs down -> cos = 3 / (sqrt(3) * 2)
    assert abs(d[4] - 3 / (3 ** 0.5 * 2)) < 1e-12 and c[4] == "A"


def test_keyed_positions_many_buckets_composite_and_timestamps(spark):
    import datetime as dt

    data = [(f"k{i % 37:02d}", (i * 7919) % 4001, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(i * 104729) % 99991))
            for i in range(4001)]
    df = spark.createDataFrame(data, "s string, n long, t timestamp_ntz").repartition(7)
    want = sorted(data, key=lambda r: (r[0], r[1]))
    got = P.with_pos(df, ["s", "n"], num_partitions=16).orderBy("pos").collect()
    assert [(r["s"], r["n"]) for r in got] == [(w[0], w[1]) for w in want]
    assert [r["pos"] for r in got] == list(range(len(want)))
    by_t = sorted(data, key=lambda r: r[2])
    got_t = P.with_pos(df, "t", num_partitions=16).orderBy("pos").collect()
    assert [r["t"] for r in got_t] == [w[2] for w in by_t]
    for lo, hi in [(0, 1), (250, 1750), (3990, 5000), (1000, 1000)]:
        sl = P.slice_rows(df, lo, hi, ["s", "n"]).orderBy("pos").collect()
        assert [(r["s"], r["n"]) for r in sl] == [(w[0], w[1]) for w in want[lo:hi]]
        assert [r["pos"] for r in sl] == list(range(lo, min(hi, len(want))))


def test_infer_roles(spark):
    assert P.infer_roles(spark.createDataFrame([("a", "b", "c")], "q string, x string, y string")) == ("q", "x, y")
    assert P.infer_roles(spark.createDataFrame([("a",)], "q string")) == ("q", "text")
    assert P.infer_roles(spark.createDataFrame([], "struct<>")) == ("id", "text")


def test_similarity_tokenless_and_missing_slots(spark):
    from promptframe.operators.similarity import similarity_scores

    long = spark.createDataFrame(
        [(1, "a", "!!"), (1, "b", "cat dog"), (1, "e", "cat"),      # alpha non-empty, no token
         (2, "a", "x"), (2, "e", "x"),                               # beta missing, one-letter texts
         (3, "e", "anything")],                                      # alpha and beta missing
        "id int, slot string, text string")
    got = {r["id"]: (r["delta"], r["winner"]) for r in similarity_scores(long, "id").collect()}
    assert got[1][1] == "B" and abs(got[1][0] + 0.7071067811865475) < 1e-12
    assert got[2] == (1.0, "A") and got[3] == (0.0, None)


def test_null_key_sorts_first_in_positions_and_slices(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(None if i == 500 else i, i % 3) for i in range(2000)], "k int, g int")
    ours = {r["k"]: r["pos"] for r in P.with_pos(df, "k", num_partitions=16).collect()}
    ref = {r["k"]: r["pos"] for r in df.select("k", (F.row_number().over(Window.orderBy("k")) - 1).alias("pos")).collect()}
    assert ours == ref and ours[None] == 0
    head = [(r["pos"], r["k"]) for r in P.slice_rows(df, 0, 3, order_by="k").orderBy("pos").collect()]
    assert head == [(0, None), (1, 0), (2, 1)]


def test_tokens_match_countvectorizer_rule_on_random_unicode(spark):
    import random
    import re

    from promptframe.functions.tokens import tokens

    rnd = random.Random(3)
    pool = list("abcXYZ019_ -.,;!?\n\t") + ["é", "É", "ß", "ﬁ", "Σ", "σ", "ς", "İ", "ı", "中", "文", "ー", "²", "½",
                                             "Ⅻ", "٣", "́", "̈", "​", "😀", "𝒜", "ǅ", "ẞ", "'"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r[0]: list(r[1]) for r in df.select("k", tokens("t")).collect()}
    rule = re.compile(r"(?u)\b\w\w+\b")                   # CountVectorizer's default token pattern
    assert all(got[i] == rule.findall(t.lower()) for i, t in enumerate(texts))


def test_similarity_partitions_grow_with_the_text(spark, monkeypatch):
    from promptframe.operators import similarity

    df = spark.createDataFrame([(i, "one two " * 50, "two three", "one two three") for i in range(64)],
                               "id int, alpha string, beta string, expected string")
    plain = rows(delta_similarities(df, "id"))
    few = delta_similarities(df, "id").rdd.getNumPartitions()
    monkeypatch.setattr(similarity, "PART_CHARS", 500)
    many = delta_similarities(df, "id")
    assert many.rdd.getNumPartitions() == -(-64 * (400 + 9 + 13) // 500) > few and rows(many) == plain
    assert delta_similarities(df.limit(0), "id").count() == 0
