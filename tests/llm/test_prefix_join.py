"""The exact prefix join of near-duplicates against all pairs, on variants of one text around the threshold."""

from __future__ import annotations

import random

from promptframe.llm import minhash


def test_prefix_pairs_hold_every_similar_pair(spark, tmp_path):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    base = rnd.choices(words, k=400)
    texts = []
    for _ in range(120):
        own = list(base)
        for i in rnd.sample(range(400), rnd.randint(0, 12)):
            own[i] = rnd.choice(words)
        texts.append(" ".join(own[rnd.randint(0, 20):400 - rnd.randint(0, 20)]))
    sets = [{tuple(t.split()[i:i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    similar = {(i, j) for i in range(120) for j in range(i + 1, 120)
               if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    packed = docs.mapInArrow(minhash._sets(4), "rid long, shingles binary")
    got = minhash._prefix_pairs(docs.selectExpr("rid", "rid as label"), packed, 80).collect()
    pairs = [(min(r), max(r)) for r in map(tuple, got)]
    assert similar <= set(pairs) and len(pairs) == len(set(pairs))
    assert 500 < len(similar) < len(pairs) <= 120 * 119 / 2
