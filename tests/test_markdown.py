"""Markdown table parsing: golden cases of the reference parser's tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptframe.operators.markdown import markdown_cells, markdown_history, parse_markdown_table, table_from_chat


def parse(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    r = parse_markdown_table(df).select("table").first()["table"]
    return None if r is None else (list(r["header"]), [list(x) for x in r["rows"]])


def test_basic_table(spark):
    assert parse(spark, "| Column1 | Column2 |\n|---|---|\n| Value1 | Value2 |") == \
        (["Column1", "Column2"], [["Value1", "Value2"]])


def test_missing_cell_padded(spark):
    assert parse(spark, "| A | B | C |\n|---|---|---|\n| 1 | 2 |") == (["A", "B", "C"], [["1", "2", ""]])


def test_blank_cells(spark):
    assert parse(spark, "| A | B | C |\n|---|---|---|\n| | Value2 | |") == (["A", "B", "C"], [["", "Value2", ""]])


def test_padding_trimmed(spark):
    assert parse(spark, "|   A   |    B |\n|---|---|\n|   x    |  y  |") == (["A", "B"], [["x", "y"]])


def test_extra_cells_dropped(spark):
    assert parse(spark, "| A | B |\n|---|---|\n| 1 | 2 | 3 |") == (["A", "B"], [["1", "2"]])


def test_not_a_table(spark):
    assert parse(spark, "Not a table at all") is None
    assert parse(spark, "") is None


def test_no_separator_row_kept(spark):
    assert parse(spark, "| A | B |\n| 1 | 2 |") == (["A", "B"], [["1", "2"]])


def test_prose_before(spark):
    assert parse(spark, "Here is a table:\n\n| A | B |\n|---|---|\n| 1 | 2 |") == (["A", "B"], [["1", "2"]])


def test_spaced_separator_skipped_colon_separator_kept(spark):
    assert parse(spark, "| A | B |\n| --- | --- |\n| 1 | 2 |") == (["A", "B"], [["1", "2"]])
    assert parse(spark, "| A | B |\n|:---|:---|\n| 1 | 2 |") == (["A", "B"], [[":---", ":---"], ["1", "2"]])


def test_single_column_two_rows(spark):
    assert parse(spark, "| A |\n|---|\n| 1 |\n| 2 |") == (["A"], [["1"], ["2"]])


def test_trailing_newline_and_prose_rows(spark):
    assert parse(spark, "| A | B |\n|---|---|\n| 1 | 2 |\n") == (["A", "B"], [["1", "2"], ["", ""]])
    assert parse(spark, "| A | B |\n| 1 | 2 |\nthanks") == (["A", "B"], [["1", "2"], ["", ""]])


def test_header_without_closing_pipe_and_midline_start(spark):
    assert parse(spark, "| A | B\n| 1 | 2 |") == (["A"], [["1"]])
    assert parse(spark, "see | A | B |\n| 1 | 2 |") == (["A", "B"], [["1", "2"]])


def test_header_only_has_no_rows(spark):
    assert parse(spark, "| A | B |\n|---|---|") == (["A", "B"], [])


def test_long_form(spark):
    df = spark.createDataFrame([(1, "| A | B |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"), (2, "none"), (3, None)],
                               "k int, text string")
    got = sorted(tuple(r) for r in markdown_cells(df, ["k"]).collect())
    assert got == [(1, 0, 0, "A", "1"), (1, 0, 1, "B", "2"), (1, 1, 0, "A", "3"), (1, 1, 1, "B", "4")]


def _history(spark, texts):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id int, turn int, text string")
    out = markdown_history(df).collect()
    if not out:
        return None
    cols = [r["col_name"] for r in sorted(out, key=lambda r: r["col_no"]) if r["turn"] == out[0]["turn"]
            and r["row_no"] == out[0]["row_no"]]
    table = {}
    for r in out:
        table.setdefault((r["turn"], r["row_no"]), {})[r["col_name"]] = r["cell"]
    return cols, [[table[k][c] for c in cols] for k in sorted(table)]


def test_history_union_fill(spark):
    got = _history(spark, ["| C1 | C2 |\n|---|---|\n| a | b |", "| C1 | C3 |\n|---|---|\n| c | d |"])
    assert got == (["C1", "C2", "C3"], [["a", "b", ""], ["c", "", "d"]])


def test_history_first_seen_order_and_skips(spark):
    got = _history(spark, ["| A | B | C |\n|---|---|---|\n| 1 | 2 | 3 |", "no table here",
                           "| B | D | E |\n|---|---|---|\n| 4 | 5 | 6 |", "| C | D | F |\n|---|---|---|\n| 7 | 8 | 9 |",
                           None])
    assert got[0] == ["A", "B", "C", "D", "E", "F"]
    assert got[1] == [["1", "2", "3", "", "", ""], ["", "4", "", "5", "6", ""], ["", "", "7", "8", "", "9"]]


def test_history_none(spark):
    assert _history(spark, ["plain", ""]) is None


def test_history_duplicate_header_suffixed(spark):
    got = _history(spark, ["| Column1 | Column1 |\n|---|---|\n| a | b |"])
    assert got == (["Column1", "Column1_2"], [["a", "b"]])


def test_extractor_choice(spark):
    turns = spark.createDataFrame([(1, 0, "user", "give me a table"), (1, 1, "assistant", "| A |\n|---|\n| x |")],
                                  "conv_id int, turn int, role string, text string")
    t = table_from_chat(turns, "Markdown Table")
    assert t.columns[0] == "Skip" and t.select("cell").first()[0] == "x"
    pairs = table_from_chat(turns, "Chat History").collect()
    assert pairs[0]["Input"] == "give me a table" and pairs[0]["Output"].startswith("| A |")
    assert table_from_chat(turns, "History w/ Tables").count() == 1
    assert table_from_chat(turns, "something else") is None
    _ = F


def _rendered(rnd, header, body):
    """One markdown table as text, in one of the usual layouts."""
    pad = rnd.choice(["", " "])
    rule = rnd.choice(["|---" * len(header) + "|", "| --- " * len(header) + "|"])
    lines = ["| " + " | ".join(header) + " |", rule]
    return "\n".join(lines + ["|" + "|".join(f"{pad}{c} " for c in row) + "|" for row in body])


def test_generated_tables_come_back(spark):
    """Cells first, then their markdown: the parser must give the cells."""
    import random

    rnd = random.Random(7)
    cell = ["a", "bc", "x y", "中文", "ü", "0.5", "a-b", "*", "é\tf"]
    texts, want = [], []
    for k in range(300):
        header = [f"h{i}" for i in range(rnd.randint(1, 5))]
        body = [[rnd.choice(cell) for _ in header] for _ in range(rnd.randint(1, 4))]
        lead = rnd.choice(["", "Here it is:\n", "no pipe here\n\n"])
        texts.append((k, lead + _rendered(rnd, header, body)))
        want.append((header, body))
    got = {r["k"]: r["table"] for r in parse_markdown_table(
        spark.createDataFrame(texts, "k int, text string")).select("k", "table").collect()}
    for k, (header, body) in enumerate(want):
        assert (list(got[k]["header"]), [list(x) for x in got[k]["rows"]]) == (header, body), texts[k]


def test_odd_tables_literal(spark):
    cases = [
        ("| A | B |\n|---|---|\n| 1 |", ["A", "B"], [["1", ""]]),                      # a short row is filled
        ("| A |\n|---|\n| 1 | 2 |", ["A"], [["1"]]),                                    # a long row is cut
        ("| A | B |\n| --- | --- |\n|  | x |", ["A", "B"], [["", "x"]]),
        ("text before | A | B |\n|---|---|\n| 1 | 2 |", ["A", "B"], [["1", "2"]]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "k int, text string")
    got = {r["k"]: r["table"] for r in parse_markdown_table(df).select("k", "table").collect()}
    for i, (_, header, body) in enumerate(cases):
        assert (list(got[i]["header"]), [list(x) for x in got[i]["rows"]]) == (header, body)
    none = spark.createDataFrame([(0, "no table"), (1, None), (2, "a|b")], "k int, text string")
    assert all(r["table"] is None for r in parse_markdown_table(none).select("table").collect())


def test_history_ignores_user_turns(spark):
    turns = spark.createDataFrame([
        (1, 0, "user", "| U |\n|---|\n| mine |"), (1, 1, "assistant", "| A |\n|---|\n| x |"),
        (1, 2, "user", "| V |\n|---|\n| last |")], "conv_id long, turn long, role string, text string")
    got = [(r["col_name"], r["cell"]) for r in table_from_chat(turns, "History w/ Tables").collect()]
    assert got == [("A", "x")]
    assert [r["cell"] for r in table_from_chat(turns, "Markdown Table").collect()] == ["x"]


def test_null_conversation_id_is_kept(spark):
    from promptframe.operators.chat import last_turn

    turns = spark.createDataFrame([(None, 1, "| a |\n| 1 |"), (None, 2, "| b |\n| 2 |"), (7, 1, "| a |\n| 3 |")],
                                  "conv_id long, turn long, text string")
    lt = {r["conv_id"]: r["last_text"] for r in last_turn(turns).collect()}
    assert lt == {None: "| b |\n| 2 |", 7: "| a |\n| 3 |"}
    hist = [(r["conv_id"], r["turn"], r["col_name"], r["cell"]) for r in markdown_history(turns).collect()]
    assert sorted(hist, key=str) == sorted([(None, 1, "a", "1"), (None, 1, "b", ""), (None, 2, "a", ""),
                                            (None, 2, "b", "2"), (7, 1, "a", "3")], key=str)
