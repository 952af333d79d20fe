"""Posting-list search against comparing every pattern with every message."""

from __future__ import annotations

import collections
import random

from promptframe.operators import trigrams as T


def test_every_hit_and_no_other(spark):
    rnd = random.Random(6)
    messages = ["".join(rnd.choice("abcABC é中%_") for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    messages += ["aaa" * 50] * 300 + [None, "", "ab", "a\nb\nc"]  # one trigram holds a hot list
    ids = [*range(len(messages) - 1), 5]  # a repeated id
    df = spark.createDataFrame(list(zip(ids, messages)), "id long, message string").repartition(5)
    index = T.build_trigrams(df)
    patterns = ["", "a", "AB", "abc", "É中", "aaaa", "%_", "c é", "nothing", "b\nc", "中", "ABCA", "abca"]
    patterns += ["".join(rnd.choice("abc ") for _ in range(4)) for _ in range(20)]
    want = collections.Counter((p, i) for p in dict.fromkeys(patterns) for i, m in zip(ids, messages)
                               if m is not None and p.lower() in m.lower())
    got = collections.Counter((r["pattern"], r["id"]) for r in T.search_messages(index, patterns).collect())
    assert got == want and want.total() > 1000


def test_rare_trigrams_leave_few_candidates(spark):
    messages = [f"the usual words number {i}" for i in range(2000)] + ["the usual words and a zebra"]
    index = T.build_trigrams(spark.createDataFrame(list(enumerate(messages)), "id long, message string"))
    found = T.candidates(index, ["usual words and a zebra", "the usual words"]).groupBy("pattern").count().collect()
    assert {r["pattern"]: r["count"] for r in found} == {"usual words and a zebra": 1, "the usual words": 2001}
    empty = T.build_trigrams(spark.createDataFrame([], "id long, message string"))
    assert T.search_messages(empty, ["abc", "a"]).count() == 0 and T.search_messages(index, []).count() == 0
