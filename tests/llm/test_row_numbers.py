"""Results when files are split differently from one scan to the next, as after a lost or late executor."""

from __future__ import annotations

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from promptframe.llm import chaining, decontaminate, minhash, stream_dedup, suffix
from promptframe.llm.common import numbered

SPLITS = {"spark.sql.files.maxPartitionBytes": ("128m", "2k"), "spark.sql.files.openCostInBytes": ("4m", "1")}


def _split(spark, k):
    for name, values in SPLITS.items():
        spark.conf.set(name, values[k])


@pytest.fixture
def docs(spark, tmp_path):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(900)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(60, 200))) for _ in range(60)]
    texts += [texts[3], texts[4], texts[5] + " " + texts[6], texts[7] + " zzz", texts[8]]
    rows = [(i, t, i * i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, other long").repartition(5).write.parquet(str(tmp_path / "d"))
    yield spark.read.parquet(str(tmp_path / "d"))
    _split(spark, 0)


def test_numbers_do_not_depend_on_splits(spark, docs):
    seen = []
    for k in (0, 1):
        _split(spark, k)
        seen.append({r["doc_id"]: r["n"] for r in numbered(docs, "n", doc_id=F.col("doc_id")).collect()})
    assert seen[0] == seen[1] and len(set(seen[0].values())) == 65


def test_operators_when_splits_change(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(docs.where("doc_id = 9").first()["text"].split()[:40]))],
                                  "item_id long, text string")
    runs = {
        "near": lambda: minhash.near_duplicates(docs).drop("rid"),
        "near stage": lambda: corpus_pipeline.near_dedup(spark, docs, ""),
        "leaks": lambda: decontaminate.leaked_documents(docs, bench),
        "chains": lambda: chaining.fuzzy_passages(docs),
        "exact": lambda: stream_dedup.deduplicate(docs),
        "repeats": lambda: suffix.remove_repeats(docs).drop("rid"),
    }

    def result(df):
        return collections.Counter(tuple(r) for r in df.collect())

    want = {name: result(run()) for name, run in runs.items()}
    assert all(want.values()) and {r[-1] for r in want["leaks"]} == {9}
    turn = itertools.count(1)
    for module in (chaining, decontaminate, minhash, stream_dedup, suffix):
        def changing(df, name, plain=module.materialise):
            out = plain(df, name)
            _split(spark, next(turn) % 2)
            return out
        monkeypatch.setattr(module, "materialise", changing)
    for name, run in runs.items():
        _split(spark, 0)
        df = run()
        _split(spark, next(turn) % 2)
        assert result(df) == want[name], name
