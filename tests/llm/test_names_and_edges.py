"""Extra columns with names the operators use themselves, and the pipeline's stages on edge rows."""

from __future__ import annotations

import collections
import random

import pytest

import corpus_pipeline
from promptframe.llm import queries as Q
from promptframe.llm import stream_dedup

CLASHING = ("__rid", "_metadata", "__file", "__row", "__number", "__place", "a.b", "q`t", "rid", "c0", "__locator", "score",
            "lang_pred", "kept", "digest", "length", "spread", "file_path")


def _rows():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(500)]
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randint(60, 200))) for _ in range(40)]
    texts = [*prose, prose[0], prose[1], prose[2] + " tail", prose[3] + " " + prose[4], None, None, "", "  \n", "1 2 3", "x",
             " ".join(rnd.choice(words) for _ in range(8_000))]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}", 0) for i, t in enumerate(texts)]
    return rows + [(None, prose[5] + " more words here", "en", None, None), (None, None, None, None, None)] + [rows[6]] * 3, prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, prose = _rows()
    root = tmp_path_factory.mktemp("edges")
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "".join(f", `{c.replace('`', '``')}` string" for c in CLASHING)
    for name, some, schema in (("plain", rows, plain), ("clash", [(*r, *CLASHING) for r in rows], plain + extra),
                               ("none", [], plain + extra)):
        spark.createDataFrame(some, schema).repartition(3).write.parquet(str(root / name / "documents.parquet"))
        spark.createDataFrame([(1, prose[7]), (2, None), (3, "")], "item_id long, text string").write.parquet(
            str(root / name / "benchmark.parquet"))
        spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int"
                              ).write.parquet(str(root / name / "labels.parquet"))
    return str(root)


#: Results that depend on nothing but texts and ids.
EXACT = ("op2", "op4", "op6", "op8", "op9", "op10", "op11", "op12", "op13")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_clashing_names_change_nothing(spark, tables, name):
    def result(folder):
        return collections.Counter(tuple(r) for r in Q.QUERIES[name](spark, f"{tables}/{folder}").collect())

    got = result("clash")
    if name.split("_")[0] in EXACT:
        assert got == result("plain")
    assert got and not result("none")


def test_pipeline_stages_on_edge_rows(spark, tables, tmp_path):
    """Every stage against its rule: which rows go, that the others stay as they are, under any names."""
    docs = spark.read.parquet(f"{tables}/clash/documents.parquet")
    names = docs.columns
    rows, prose = _rows()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{tables}/clash")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == names
            seen[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert all(tuple(r[-len(CLASHING):]) == CLASHING for r in docs.collect())
    letters = collections.Counter((r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    assert collections.Counter(seen["language_id"]) == letters
    largest = {}
    for i, t in letters.elements():
        if t not in largest or (i is not None and (largest[t] is None or i > largest[t])):
            largest[t] = i
    assert collections.Counter(seen["exact_dedup"]) == collections.Counter((i, t) for t, i in largest.items())
    near = {(i, t) for i, t in seen["near_dedup"]}
    # Of a text and its near copy (one word more) one stays; all others do.
    assert len(seen["exact_dedup"]) - len(near) == 2 and near <= set(seen["exact_dedup"])
    gone = set(seen["near_dedup"]) - set(seen["decontamination"])
    assert {t for _, t in gone} == {prose[7]}
    packed = docs.groupBy("doc_id").sum("length").count()
    assert packed == len({i for i, _ in seen["decontamination"]})


def test_pipeline_on_an_empty_table(spark, tables):
    assert corpus_pipeline.run(spark, f"{tables}/none").count() == 0


def test_texts_under_one_digest_are_told_apart(spark):
    """What the exact stage does when a digest covers two texts: groups by bytes, sizes and keepers of each."""
    rows = [(10, 1, "a"), (11, 2, "a"), (12, 3, "b"), (13, 4, "b"), (14, 5, "a"), (15, 6, "c")]
    found = spark.createDataFrame([("d", i, loc, 15, 6, 6) for i, loc, _ in rows] + [("e", 1, 9, 1, 9, 1)],
                                  "digest string, id long, locator long, keep_id long, keep_locator long, group_size long")
    compared = spark.createDataFrame([("d", i, loc, 15, 6, 6, t == "c", None if t == "c" else t) for i, loc, t in rows],
                                     "digest string, id long, locator long, keep_id long, keep_locator long, group_size long, "
                                     "__same boolean, __text string")
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in stream_dedup.regroup(found, compared).collect()}
    assert got == {10: (14, 3, False), 11: (14, 3, False), 14: (14, 3, True), 12: (13, 2, False), 13: (13, 2, True),
                   15: (15, 1, True), 1: (1, 1, True)}
