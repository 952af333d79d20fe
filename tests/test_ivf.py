"""Inverted-file and tiled search against brute force: exact with all lists, recall with few, hot lists, edge rows."""

from __future__ import annotations

import numpy as np
import pytest

from promptframe.operators import ivf
from promptframe.operators import vectors as V


def _frame(spark, ids, x, names=("id", "vector"), kind="long"):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in zip(ids, x)],
                                 f"{names[0]} {kind}, {names[1]} array<double>").repartition(4)


def _brute(q, s, k, metric, ids):
    if metric == "cosine":
        unit = [m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None] for m in (q, s)]
        score = unit[0] @ unit[1].T
    else:
        score = -np.sqrt(np.maximum(((q[:, None] - s[None]) ** 2).sum(-1), 0))
    return [[ids[j] for j in sorted(range(len(s)), key=lambda j: (-round(row[j], 9), ids[j]))[:k]] for row in score]


def _hits(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["q_id"], r["rank"])):
        out.setdefault(r["q_id"], []).append(r["s_id"])
        assert r["rank"] == len(out[r["q_id"]])
    return out


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16)) * 3
    s = centres[rng.integers(0, 30, 1200)] + rng.normal(size=(1200, 16))
    q = centres[rng.integers(0, 30, 60)] + rng.normal(size=(60, 16))
    return s, q


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_few_lists_reach_the_recall_and_all_lists_are_exact(spark, planted, tmp_path, metric, monkeypatch):
    s, q = planted
    monkeypatch.setattr(ivf, "PART_ROWS", 20)  # lists in several parts
    path = str(tmp_path / "index")
    ivf.build_ivf(_frame(spark, range(1200), s), metric=metric, path=path)
    index = ivf.load_ivf(spark, path)
    assert len(index.centres) == 34 and index.sizes.sum() == 1200
    queries = _frame(spark, range(60), q, ("q_id", "vector"))
    want = _brute(q, s, 5, metric, list(range(1200)))
    assert _hits(ivf.search_ivf(index, queries, 5, nprobe=34)) == dict(enumerate(want))
    few = _hits(ivf.search_ivf(index, queries, 5))
    found = sum(len(set(few[i]) & set(want[i])) for i in range(60))
    assert found >= 0.9 * 300
    scanned = index.sizes[ivf._visits(ivf._unit(q) if metric == "cosine" else q, index.centres, ivf.NPROBE)].sum() / (60 * 1200)
    assert scanned < 0.5


def test_a_list_with_most_rows_is_cut_into_parts(spark, monkeypatch):
    """Two thirds of the rows are one vector: their list's tiles stand in several parts, ties go to the smaller id."""
    monkeypatch.setattr(ivf, "PART_ROWS", 100)
    rng = np.random.default_rng(3)
    s = np.r_[np.tile([[1.0, 2, 3, 4]], (800, 1)), rng.normal(size=(400, 4))]
    index = ivf.build_ivf(_frame(spark, range(1200), s), lists=10)
    hot = int(np.argmax(index.sizes))
    parts = index.tiles.where(f"list = {hot}").select("part").distinct().count()
    assert index.sizes[hot] >= 800 and parts == -(-int(index.sizes[hot]) // 100)
    got = _hits(ivf.search_ivf(index, _frame(spark, [0], [[1.0, 2, 3, 4]], ("q_id", "vector")), 4))
    assert got == {0: [0, 1, 2, 3]}


def test_tiled_search_matches_brute_force(spark, planted):
    s, q = planted
    ids = [f"v{i:04d}" for i in range(1200)]
    store = _frame(spark, [*ids, "none"], [*s, None], kind="string")
    queries = _frame(spark, [*range(60), 99], [*q, None], ("q_id", "vector"))
    got = _hits(ivf.knn_tiled(queries, store, 4, part_rows=300))
    assert got == dict(enumerate(_brute(q, s, 4, "cosine", ids)))
    # The search that checks sizes goes this way when neither side may be broadcast.
    assert _hits(V.knn_search(queries, store, 4, broadcast_limit=16 * 8 * 10)) == got


def test_edges(spark):
    store = _frame(spark, range(5), [[1.0, 0], [0, 1.0], [0.0, 0], None, [1.0, 1.0]])
    queries = _frame(spark, [1], [[1.0, 0.1]], ("q_id", "vector"))
    none = store.limit(0)
    assert ivf.search_ivf(ivf.build_ivf(none), queries).count() == 0
    assert ivf.knn_tiled(queries, none).count() == 0 and ivf.knn_tiled(queries.limit(0), store).count() == 0
    index = ivf.build_ivf(store, lists=50)
    assert _hits(ivf.search_ivf(index, queries, 10, nprobe=50)) == {1: [0, 4, 1, 2]}
    assert _hits(ivf.search_ivf(index, store.withColumnRenamed("id", "q_id"), 1, nprobe=50, exclude_self=True))[0] == [4]
    with pytest.raises(Exception, match="unequal length"):
        ivf.search_ivf(index, _frame(spark, [1], [[1.0]], ("q_id", "vector"))).collect()
    with pytest.raises(ValueError):
        ivf.build_ivf(store, metric="dot")


def test_top_is_the_total_order(monkeypatch):
    """Scores with many ties, in groups and not: the greatest first, equal ones by place."""
    rng = np.random.default_rng(4)
    for n, k in ((3, 5), (40, 3), (1000, 3), (1001, 7)):
        for high in (3, 10 ** 6):
            scores = rng.integers(0, high, (50, n)).astype(float)
            scores[0] = -np.inf
            row, col, rank = V._top(scores, k)
            want = [sorted(range(n), key=lambda j: (-line[j], j))[:k] for line in scores]
            assert [col[row == i].tolist() for i in range(50)] == want
            assert rank.tolist() == [r + 1 for w in want for r in range(len(w))]


def test_all_lists_send_no_tile_once_for_each_list(spark, planted, monkeypatch):
    """Where all meet all, a tile goes to the groups of the other side, however many lists or parts there are."""
    s, q = planted
    monkeypatch.setattr(ivf, "CELL_VALUES", 16 * 400)  # three groups of the store (a group holds a tile's rows at least)
    index = ivf.build_ivf(_frame(spark, range(1200), s), lists=60)
    queries = _frame(spark, range(60), q, ("q_id", "vector"))
    want = dict(enumerate(_brute(q, s, 5, "cosine", list(range(1200)))))
    sent = []
    crossed = ivf._crossed

    def counted(queries, store, *args):
        sent.append(queries.count())
        return crossed(queries, store, *args)

    monkeypatch.setattr(ivf, "_crossed", counted)
    assert _hits(ivf.search_ivf(index, queries, 5, nprobe=60)) == want
    assert _hits(ivf.knn_tiled(queries, _frame(spark, range(1200), s), 5, part_rows=20)) == want
    assert max(sent) <= 4  # tiles of 60 queries, where each list or part of 20 rows would have its own


def test_tiles_are_not_broadcast_by_a_guessed_size(spark, planted):
    s, q = planted
    queries = _frame(spark, range(60), q, ("q_id", "vector"))
    plan = ivf.search_ivf(ivf.build_ivf(_frame(spark, range(1200), s), lists=60), queries, 5, nprobe=7)
    assert "SortMergeJoin" in plan._jdf.queryExecution().executedPlan().toString()
    plan = ivf.knn_tiled(queries, _frame(spark, range(1200), s), 5, part_rows=20)
    assert "FlatMapCoGroupsInArrow" in plan._jdf.queryExecution().executedPlan().toString()
