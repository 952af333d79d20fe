"""FAQ templating and message history: golden cases."""

from __future__ import annotations

import datetime as dt

import pytest

from promptframe.operators import history as H
from promptframe.operators.faq import faq_fix, faq_link_text


def _faq(spark, rows):
    df = spark.createDataFrame(rows, "Q string, A string, text string")
    return {r["Q"]: r for r in faq_fix(df).collect()}


def test_faq_no_answer_and_general(spark):
    got = _faq(spark, [
        ("What is the weather?", "<NO ANSWER/>", "Q: What is the weather?\nA: No information available"),
        ("How to reset password?", "You can reset it in settings.",
         "Q: How to reset password?\nA: You can reset it in settings."),
        ("What is your name?", "My name is Assistant.", "Q: What is your name?\nA: My name is Assistant."),
    ])
    w = got["What is the weather?"]
    assert w["rdb_text"] == "No information available"
    assert len(w["faq_id"]) == 24
    assert w["faq_text"] == ("Q: What is the weather?\nA: For more information about `What is the weather?`, please "
                             f"visit the following link: [What is the weather?](faq:{w['faq_id']}).")
    n = got["What is your name?"]
    assert n["rdb_text"] == "My name is Assistant."
    assert n["faq_text"] == ("Q: What is your name?\nA: My name is Assistant. For more details, please see the link "
                             f"[What is your name?](faq:{n['faq_id']}).")
    assert got["How to reset password?"]["rdb_text"] == "You can reset it in settings."


def test_faq_cut_at_second_marker_missing_marker_and_braces(spark):
    got = _faq(spark, [("x", "y", "Q: x\nA: one A: two"), ("z", "w", "Q: z only"), ("{b}", "{c}", "plain {d}")])
    assert got["x"]["rdb_text"] == "one "
    assert got["z"]["rdb_text"] is None and got["z"]["faq_error"]
    assert got["{b}"]["rdb_text"] == "plain {d}"
    assert got["{b}"]["faq_text"].startswith("Q: {b}\nA: {c} For more details")


def test_faq_missing_columns(spark):
    df = spark.createDataFrame([("a",)], "Q string")
    with pytest.raises(ValueError):
        faq_fix(df)


def test_faq_link_variants(spark):
    df = spark.createDataFrame([("问题", "<NO ANSWER/>"), ("q2", "ans")], "Q string, Output string")
    txt = {r["Q"]: r for r in faq_link_text(df).collect()}
    fid = txt["问题"]["faq_id"]
    assert len(fid) == 32
    assert txt["问题"]["faq_text"] == f"Q: 问题\nA: 关于 问题，详见链接 [问题](faq: {fid})"
    js = {r["Q"]: r["faq_text"] for r in faq_link_text(df, as_json=True).collect()}
    assert js["q2"].startswith('{"question":"q2","answer":"ans\\n详见链接')


def _log(spark, items):
    return spark.createDataFrame([("log", ts, m) for ts, m in items], "log string, ts timestamp, message string")


def test_touch_keeps_one_row_latest_ts(spark):
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    got = H.latest(_log(spark, [(a, "hello"), (b, "hello")])).collect()
    assert len(got) == 1 and got[0]["ts"] == b


def test_retention_drops_oldest(spark):
    items = [(dt.datetime(2024, 1, 1, 0, i), f"Message {i}") for i in range(6)]
    got = {r["message"] for r in H.retained(_log(spark, items), cap=5).collect()}
    assert "Message 0" not in got and len(got) == 5


def test_listing_newest_first_truncated_nulls_dropped(spark):
    items = [(dt.datetime(2024, 1, 1, 0, i), m) for i, m in enumerate(["a", "b" * 1500, "c", None])]
    got = H.listing(_log(spark, items), cap=10, max_length=1000).orderBy("rank").collect()
    assert [r["message"][:1] for r in got] == ["c", "b", "a"]
    assert len(got[1]["message"]) == 1000


def _listed(spark, msgs):
    items = [(dt.datetime(2024, 1, 1, 0, i), m) for i, m in enumerate(msgs)]
    return H.listing(_log(spark, items), cap=100)


def test_filter_messages(spark):
    listed = _listed(spark, ["hello world", "goodbye", "hello universe", "other"])
    assert {r["message"] for r in H.filter_messages(listed, "hello").collect()} == {"hello world", "hello universe"}
    assert H.filter_messages(listed, "  ").count() == 4
    assert H.filter_messages(listed, "goodbye").count() == 4   # single exact match -> everything
    assert H.filter_messages(listed, "GOOD").count() == 1


def test_exists_semi_join(spark):
    hist = _log(spark, [(dt.datetime(2024, 1, 1), "x")])
    cand = spark.createDataFrame([("log", "x"), ("log", "y")], "log string, message string")
    assert [r["message"] for r in H.exists(hist, cand).collect()] == ["x"]


def test_lru_equivalence_with_sequential_replay(spark):
    """Set-based retention equals replaying appends one at a time."""
    import random

    rng = random.Random(7)
    events = [(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), f"m{rng.randint(0, 30)}") for i in range(300)]
    cap = 8
    store = {}
    for ts, m in events:
        store[m] = ts
        if len(store) > cap:
            oldest = min(store, key=store.get)
            del store[oldest]
    got = {r["message"]: r["ts"] for r in H.retained(_log(spark, events), cap=cap).collect()}
    assert got == store


def test_chat_pairs_null_conversation(spark):
    from promptframe.operators.chat import chat_pairs

    turns = spark.createDataFrame([(None, 0, "user", "q0"), (None, 1, "assistant", "a0"), (None, 2, "user", "q1"),
                                   (5, 0, "user", "q5")], "conv_id long, turn long, role string, text string")
    got = sorted(((r["turn"], r["Input"], r["Output"]) for r in chat_pairs(turns).collect()), key=str)
    assert got == sorted([(0, "q0", "a0"), (2, "q1", None), (0, "q5", None)], key=str)


def test_filter_messages_cases(spark):
    from promptframe.operators.history import filter_messages

    listed = spark.createDataFrame([("a", 0, "hello"), ("a", 1, "say HELLO world"), ("a", 2, "bye"),
                                    ("b", 0, "hello"), ("b", 1, "x"), ("c", 0, "über alles")],
                                   "log string, rank int, message string")
    cases = {
        "hello": [("a", 0), ("a", 1), ("b", 0), ("b", 1)],   # b: one hit equal to the query shows the whole log
        "HELLO": [("a", 0), ("a", 1), ("b", 0)],             # b: one hit, but not equal to the query
        "bye": [("a", 0), ("a", 1), ("a", 2)],
        "ÜBER": [("c", 0)],
        "zzz": [],
        "  ": [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0)],
    }
    for query, want in cases.items():
        got = sorted((r["log"], r["rank"]) for r in filter_messages(listed, query).collect())
        assert got == want, query
