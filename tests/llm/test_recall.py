"""Recall of the corpus operators' candidate searches on planted cases, against the alignment itself."""

from __future__ import annotations

import random

import numpy as np

from promptframe.llm import decontaminate
from promptframe.llm.align import lcs


def _vocabulary(rnd, size=6000):
    words = [f"{''.join(rnd.choice('aeioulnrst') for _ in range(rnd.randint(2, 6)))}{i:x}" for i in range(size)]
    return words, [1 / (i + 5) for i in range(size)]


def test_leaks_of_a_large_benchmark(spark, tmp_path):
    rnd = random.Random(7)
    words, odds = _vocabulary(rnd)

    def prose(n):
        return rnd.choices(words, odds, k=n)

    bench = [prose(40) for _ in range(3000)]
    code = {w: i for i, w in enumerate(words)}
    docs, want = [], set()
    for i in range(600):
        passage = list(bench[5 * i])
        for at in rnd.sample(range(40), (0, 4, 10)[i % 3]):
            passage[at] = prose(1)[0]
        docs.append((i, " ".join(prose(rnd.randint(0, 80)) + passage + prose(rnd.randint(0, 80)))))
        given, there = (np.array([code[w] for w in x], np.uint64) for x in (bench[5 * i], passage))
        if lcs(given, there) >= 0.65 * 40 and lcs(given[-40:], there) >= 0.5 * 40:
            want.add((i, 5 * i))
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(path)
    table = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(bench)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"])
           for r in decontaminate.leaked_documents(spark.read.parquet(path), table).collect()}
    assert len(want) == 600 and not want - got
