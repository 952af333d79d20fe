"""Literal cells: Python's and JSON's own parsers as the measure, types over all cells, errors by row."""

from __future__ import annotations

import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptframe.functions.literals import LiteralError, canonical, parse_literal
from promptframe.operators.llm import bang_columns

_LEAVES = st.none() | st.booleans() | st.integers(-10 ** 20, 10 ** 20) | st.floats(allow_nan=False, allow_infinity=False) | st.text()
_VALUES = st.recursive(_LEAVES, lambda v: st.lists(v) | st.dictionaries(st.text(), v) | st.lists(v).map(tuple), max_leaves=25)


def _plain(v):
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else v


@settings(max_examples=300, deadline=None)
@given(_VALUES)
def test_both_spellings_come_back(value):
    def text_ok(v):
        return all(map(text_ok, v)) if isinstance(v, (list, tuple)) else all(text_ok(k) and text_ok(x) for k, x in v.items()) \
            if isinstance(v, dict) else not isinstance(v, str) or not any("\ud800" <= c <= "\udfff" for c in v)

    if not text_ok(value):
        return
    assert parse_literal(repr(value)) == _plain(value)
    assert parse_literal(json.dumps(value)) == parse_literal(json.dumps(value, ensure_ascii=False)) == _plain(value)


@pytest.mark.parametrize("text", [
    "{'a': 'it\\'s', \"b\": \"x\"}", "(1,)", "(1)", "()", "[1, 2, ]", "'a' \"b\"", "'''x'y\n'''", "r'\\d'", "0x1F", "-1_000", ".5", "1.",
    "1e3", "'\\x41\\u00e9\\U0001F600\\101\\N{BULLET}'", "'a\\\nb'", "+3", "- 2", "{1: 2, None: 3, 1.5: 4}", "'\\q'", "[[], {}, ((),)]"])
def test_python_spellings(text):
    def keyed(v):
        if isinstance(v, dict):
            return {k if isinstance(k, str) else json.dumps(k): keyed(x) for k, x in v.items()}
        return [keyed(x) for x in v] if isinstance(v, (list, tuple)) else v

    assert parse_literal(text) == keyed(ast.literal_eval(text))


@pytest.mark.parametrize("text", ["x", "[1", "{'a' 1}", "{'a': 1, 2}", "__import__('os')", "1 2", "'a", "[1,,2]", "NaN", "1e999", "{[1]: 2}",
                                  "f'x'", "'\\ud800'", "[" * 500 + "]" * 500, "1 + 1", "007", "'\\N{NO SUCH NAME}'", "b'x'", "1.2.3"])
def test_what_is_no_literal(text):
    with pytest.raises(LiteralError):
        parse_literal(text)
    assert canonical(text)[0] is None and canonical(text)[1]


def test_mixed_spellings_in_a_column(spark):
    cells = ["{'a': 1, 't': (True, None)}", '{"a": 2, "t": [false, true]}', "{'a': 3.5, 'late': 'it''s'}", "{'a': oops}", None, " ",
             '{"a": 1, "a": 9}'] + ["{'a': None}"] * 2000
    df = spark.createDataFrame(list(enumerate(cells)), "k int, `!v` string").repartition(4)
    out = bang_columns(df, error_col="errors")
    assert out.columns == ["k", "v", "errors"]
    assert out.schema["v"].dataType.simpleString() == "struct<a:double,late:string,t:array<boolean>>"
    got = {r["k"]: r for r in out.where("k < 8").collect()}
    assert got[0]["v"].asDict() == {"a": 1.0, "late": None, "t": [True, None]} and got[1]["v"]["t"] == [False, True]
    assert got[2]["v"].asDict() == {"a": 3.5, "late": "its", "t": None} and got[6]["v"]["a"] == 9.0
    assert got[3]["v"] is None and "oops" in got[3]["errors"]["v"]
    assert all(got[k]["errors"] is None for k in (0, 1, 2, 4, 5, 6, 7)) and got[4]["v"] is None and got[5]["v"] is None
