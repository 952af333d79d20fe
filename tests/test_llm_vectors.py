"""LLM maps, embeddings, vector table, search and clustering."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptframe.operators import vectors as V
from promptframe.operators.cluster import ClusterGuard, cluster_vectors, write_back
from promptframe.operators.embed import embed_rows, embed_table
from promptframe.operators.llm import bang_columns, llm_batch, llm_map
from promptframe.operators.metaprompt import optimize_prompts

from .conftest import rows


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def test_llm_batch_history_skip_and_fallback(spark):
    df = spark.createDataFrame([("", "QA", 1), ("skip", "Dev", 2), ("", "BAD", 3)], "Skip string, role string, k int")
    res = llm_batch(df, "You are a {role}.", "What is your role?", {"type": "md5-echo", "fail_on": "BAD"},
                    history=[("hi", "hello")], batch_size=2)
    got = {r["k"]: r for r in res.collect()}
    assert set(got) == {1, 3}
    t = "system: You are a QA.\nhuman: hi\nai: hello\nhuman: What is your role?"
    assert got[1]["Output"] == _md5(t) and got[1]["status"] == "ok"
    assert got[3]["Output"] == "" and got[3]["status"] == "error" and "stub failure" in got[3]["error"]


def test_llm_fail_mode_raises(spark):
    df = spark.createDataFrame([("BAD",)], "p string")
    with pytest.raises(Exception):
        llm_map(df, "p", {"type": "md5-echo", "fail_on": "BAD"}, on_error="fail").collect()
    with pytest.raises(ValueError):
        llm_map(df, "p", {"type": "md5-echo"}, batch_size=0)


def test_bang_columns(spark):
    df = spark.createDataFrame([("hello", '{"temp": 0.5}'), ("world", '{"temp": 0.7}')], "input string, `!config` string")
    out = bang_columns(df)
    assert out.columns == ["input", "config"]
    assert rows(out.select("input", "config.temp")) == [("hello", 0.5), ("world", 0.7)]


def test_bang_columns_type_from_every_row(spark):
    cells = [(i, '{"a": %d}' % i) for i in range(3000)] + [(3000, '{"a": 1, "late": [1.5]}'), (3001, "{'a': 7}"),
                                                           (3002, "not json"), (3003, None)]
    df = spark.createDataFrame(cells, "k int, `!v` string").repartition(4)
    out = bang_columns(df)
    assert out.schema["v"].dataType.simpleString() == "struct<a:bigint,late:array<double>>"
    got = {r["k"]: r for r in out.select("k", "v.a", "v.late").collect()}
    assert got[3000]["late"] == [1.5] and got[3001]["a"] == 7 and got[3002]["a"] is None
    mixed = bang_columns(spark.createDataFrame([('{"a": 1}',), ("[1, 2]",)], "`!m` string"))
    assert mixed.schema["m"].dataType.simpleString() == "variant"
    empty = bang_columns(spark.createDataFrame([(None,), ("x",)], "`!e` string"))
    assert [r[0] for r in empty.collect()] == [None, None]


def test_optimize_prompts_loop(spark):
    df = spark.createDataFrame([(1, "Be helpful.", "hi", "hello", None)],
                               "k int, current_system_prompt string, testing_user_prompt string, "
                               "expect_output string, current_output string")
    gen, tester = {"type": "append-suffix"}, {"type": "md5-echo"}
    zero = optimize_prompts(df, "k", gen, tester, "meta", iterations=0).first()
    assert zero["current_system_prompt"] == "Be helpful." and zero["changed"] is False
    one = optimize_prompts(df, "k", gen, tester, "meta", iterations=1).first()
    assert one["current_system_prompt"] == "Be helpful. Be concise." and one["changed"] is True
    three = optimize_prompts(df, "k", gen, tester, "meta", iterations=3).first()
    # second round reports no change and stops the row
    assert three["current_system_prompt"] == "Be helpful. Be concise." and three["changed"] is False


def test_embed_batches_and_blank_key(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, "world hello")], "id int, text string")
    for bs in (1, 2):
        got = {r["id"]: r["Vector"] for r in embed_rows(df, "text", {"type": "hashing", "dim": 16}, bs).collect()}
        assert len(got[1]) == 16 and np.allclose(got[1], got[3]) and not any(got[2])
    t = embed_table(df, "text", "id", {"type": "hashing", "dim": 8}, start=1, end=3, order_by="id")
    assert t.columns == ["Vector", "id"] and sorted(r["id"] for r in t.collect()) == [2, 3]


def test_parse_vector_text(spark):
    df = spark.createDataFrame([("[0.1, 0.2, 0.3]",), ("oops",)], "v string")
    got = V.parse_vectors(df, "v").select("vector").collect()
    assert got[0][0] == [0.1, 0.2, 0.3] and got[1][0] is None


def _brute_topk(q, s, k):
    qn = q / np.linalg.norm(q, axis=1, keepdims=True)
    sn = s / np.linalg.norm(s, axis=1, keepdims=True)
    sc = qn @ sn.T
    return {i: [int(j) for j in sorted(range(len(s)), key=lambda j: (-sc[i, j], j))[:k]] for i in range(len(q))}


@pytest.mark.parametrize("limit", [V.BROADCAST_LIMIT_BYTES, 64 * 8 * 10, 16])
def test_knn_matches_brute_force_all_paths(spark, limit):
    rng = np.random.default_rng(3)
    q = rng.normal(size=(37, 8))
    s = rng.normal(size=(211, 8))
    s[5] = s[4]                      # exact duplicate: tie broken by id
    qdf = spark.createDataFrame([(i, q[i].tolist()) for i in range(len(q))], "q_id long, vector array<double>")
    sdf = spark.createDataFrame([(j, s[j].tolist()) for j in range(len(s))], "id long, vector array<double>")
    got = V.knn_search(qdf, sdf, k=4, broadcast_limit=limit).collect()
    res = {}
    for r in sorted(got, key=lambda r: (r["q_id"], r["rank"])):
        res.setdefault(r["q_id"], []).append(r["s_id"])
    assert res == _brute_topk(q, s, 4)


def test_vector_table_ops(spark):
    recs = spark.createDataFrame([("a", [1.0, 0.0], "x", {}), ("b", [0.0, 1.0], "y", {})], V.STORE_SCHEMA)
    inc = spark.createDataFrame([("c", [1.0, 1.0], "x", {}), ("d", [2.0, 2.0], "x", {})], V.STORE_SCHEMA)
    up = V.upsert(recs, inc, overwrite=True)
    assert rows(up.select("id", "text")) == [("b", "y"), ("d", "x")]
    assert V.upsert(recs, inc, overwrite=False).count() == 4
    assert rows(V.delete(recs, spark.createDataFrame([("a",)], "id string")).select("id")) == [("b",)]
    assert V.clear(recs).count() == 0
    st = V.stats(recs).first()
    assert (st["vector_count"], st["dimension_min"], st["dimension_max"]) == (2, 2, 2)


def test_cluster_guards_and_labels(spark):
    one = spark.createDataFrame([(1, [0.0, 1.0])], "id long, v array<float>")
    with pytest.raises(ClusterGuard):
        cluster_vectors(one, "id", "v", clusters=2)
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(0, 0.05, (20, 2)) + [1, 0], rng.normal(0, 0.05, (20, 2)) + [-1, 0]])
    df = spark.createDataFrame([(i, pts[i].tolist()) for i in range(40)], "id long, v array<double>")
    for method in ("pic", "kmeans"):
        lab = {r["id"]: r["Cluster"] for r in cluster_vectors(df, "id", "v", 2, label_base=5, method=method,
                                                             n_neighbors=5).collect()}
        assert len(lab) == 40 and set(lab.values()) == {5, 6}
        assert len({lab[i] for i in range(20)}) == 1 and len({lab[i] for i in range(20, 40)}) == 1


def test_write_back_slice(spark):
    df = spark.createDataFrame([(i, 9) for i in range(5)], "k int, Cluster int")
    lab = spark.createDataFrame([(0, 1), (1, 2)], "pos long, label int")
    got = [r["Cluster"] for r in write_back(df, lab, 1, 3, order_by="k").orderBy("k").collect()]
    assert got == [9, 1, 2, 9, 9]
    fresh = [r["Cluster"] for r in write_back(df, lab, 1, 3, recreate=True, order_by="k").orderBy("k").collect()]
    assert fresh == [None, 1, 2, None, None]
    with pytest.raises(ClusterGuard):
        write_back(df, lab, 0, 3, order_by="k")
    _ = F


def test_vector_store_sink_batches_and_shapes(spark):
    import json
    import os

    from promptframe.session import fs_path, scratch_path
    from promptframe.sources.vectorstore import write_vectors

    df = spark.createDataFrame(
        [(f"id{i}", [float(i), 1.0], f"t{i}" if i % 2 else None, {"k": str(i)}) for i in range(10)],
        "id string, vector array<float>, text string, metadata map<string,string>").coalesce(1)
    path = scratch_path(spark, "sink-test")
    write_vectors(df, {"type": "jsonl-folder", "path": path}, batch_size=3)
    files = sorted(f for f in os.listdir(fs_path(path)) if f.startswith("batch-"))
    assert len(files) == 4                                   # 3 + 3 + 3 + 1 rows
    got = {}
    for f in files:
        with open(os.path.join(fs_path(path), f)) as fh:
            for line in fh:
                r = json.loads(line)
                got[r["id"]] = r
    assert set(got) == {f"id{i}" for i in range(10)}
    assert got["id3"]["metadata"] == {"k": "3", "text": "t3"} and got["id4"]["metadata"] == {"k": "4"}
    assert got["id3"]["vector"] == [3.0, 1.0]
    # The same write again (a retried job) rewrites the same batch files.
    write_vectors(df, {"type": "jsonl-folder", "path": path}, batch_size=3)
    assert sorted(f for f in os.listdir(fs_path(path)) if f.startswith("batch-")) == files

    fields = scratch_path(spark, "sink-fields")
    write_vectors(df.select("vector", F.lit(7).alias("label")), {"type": "jsonl-folder", "path": fields},
                  batch_size=100, shape="fields")
    back = spark.read.json(fields)
    assert back.count() == 10 and set(back.columns) == {"vector", "label"}
    with pytest.raises(Exception):
        write_vectors(df.select("vector"), {"type": "jsonl-folder", "path": fields}, shape="records")


def test_knn_skips_null_vectors(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0])], "id string, vector array<float>")
    qs = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "q_id int, vector array<float>")
    got = [(r["q_id"], r["rank"], r["s_id"]) for r in V.knn_search(qs, store, k=3).orderBy("q_id", "rank").collect()]
    assert got == [(1, 1, "a"), (1, 2, "c")]


def test_upsert_keeps_records_without_text(spark):
    schema = "id string, vector array<float>, text string, metadata map<string,string>"
    store = spark.createDataFrame([("s1", [1.0], "a", {}), ("s2", [2.0], None, {})], schema)
    inc = spark.createDataFrame([("n1", [3.0], "a", {}), ("n2", [4.0], None, {}), ("n3", [5.0], None, {})], schema)
    assert sorted(r["id"] for r in V.upsert(store, inc, overwrite=True).collect()) == ["n1", "n2", "n3", "s2"]


def test_cluster_table_one_call(spark):
    from promptframe.operators.cluster import cluster_table

    df = spark.createDataFrame([(i, f"r{i}") for i in range(6)], "k int, name string")
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.05]), (2, [-1.0, 0.0]), (3, [-1.0, 0.05])],
                                 "pos long, vector array<double>")
    out = {r["k"]: r["Cluster"] for r in cluster_table(df, vecs, clusters=2, label_base=10, start=1, end=5,
                                                       order_by="k", method="kmeans").collect()}
    assert out[0] is None and out[5] is None
    assert out[1] == out[2] and out[3] == out[4] and {out[1], out[3]} == {10, 11}
    with pytest.raises(ClusterGuard):
        cluster_table(df, vecs, clusters=2, start=0, end=3, order_by="k")          # 4 vectors, 3 rows
    with pytest.raises(ClusterGuard):
        cluster_table(df, vecs, clusters=5, start=1, end=5, order_by="k")          # fewer vectors than clusters
    with pytest.raises(ClusterGuard):
        cluster_table(df.limit(1), vecs, clusters=2, order_by="k")                 # table of one row


def test_import_vectors_count_check_writes_nothing(spark):
    import os

    from promptframe.session import fs_path, scratch_path

    t = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "k int, name string")
    vecs = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "pos long, vector array<float>")
    path = scratch_path(spark, "t-import")
    with pytest.raises(ValueError, match="same"):
        V.import_vectors(t, "name", vecs, {"type": "jsonl-folder", "path": path}, start=0, end=3, order_by="k")
    assert not os.path.exists(fs_path(path))
    V.import_vectors(t, "name", vecs, {"type": "jsonl-folder", "path": path}, start=3, end=5, order_by="k")
    back = {r["vector"][0]: r["metadata"]["name"] for r in spark.read.json(path).collect()}
    assert back == {1.0: "n3", 2.0: "n4"}


def test_embed_import_calls_the_model_once_and_keeps_repeated_texts(spark, tmp_path, monkeypatch):
    from promptframe.operators import embed as E

    calls = spark.sparkContext.accumulator(0)
    mapper = E._embed_mapper

    def counted(*args):
        inner = mapper(*args)

        def run(batches):
            for out in inner(batches):
                calls.add(len(out))
                yield out
        return run

    monkeypatch.setattr(E, "_embed_mapper", counted)
    df = spark.createDataFrame([(1, "same text"), (2, "same text"), (3, ""), (4, None)], "k int, t string")
    path = str(tmp_path / "store")
    records = E.embed_import(df, "t", "k", {"type": "hashing", "dim": 8}, {"type": "jsonl-folder", "path": path})
    stored = spark.read.schema("id string, vector array<float>, metadata map<string,string>").json(path)
    got = rows(stored, "id", F.col("metadata")["k"])
    assert len({r[0] for r in got}) == 4 and sorted(r[1] for r in got) == ["1", "2", "3", "4"]
    assert got == rows(records, "id", F.col("metadata")["k"])
    assert calls.value == 4


def test_hits_carry_text_and_metadata(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0], "first", {"n": "1"}), ("b", [0.0, 1.0], None, None)],
                                  "id string, vector array<float>, text string, metadata map<string,string>")
    queries = spark.createDataFrame([("q", [1.0, 0.1])], "q_id string, vector array<float>")
    hits = V.with_content(V.knn_search(queries, store, k=2), store)
    assert [(r.s_id, r.text, r.metadata) for r in hits.orderBy("rank").collect()] == [("a", "first", {"n": "1"}),
                                                                                        ("b", None, None)]
    shown = V.hits_json(hits).first()["hits"]
    assert '"text":"first"' in shown and '"metadata":{"n":"1"}' in shown


def test_azure_requests_and_final_errors(monkeypatch):
    import urllib.error

    from promptframe.operators import clients as C

    sent = []

    def post(url, body, headers, timeout, retries):
        sent.append((url, headers))
        return {"choices": [{"message": {"content": "ok"}}], "data": [{"index": 0, "embedding": [1.0]}]}

    opts = {"deployment": "d1", "base_url": "https://x.example/", "api_version": "2023-05-15", "api_key": "k"}
    tried = []

    def refuse(req, timeout):
        tried.append(req.full_url)
        raise urllib.error.HTTPError(req.full_url, 401, "no", {}, None)

    monkeypatch.setattr(C.urllib.request, "urlopen", refuse)
    with pytest.raises(urllib.error.HTTPError):
        C._post_json("https://x.example", {}, {}, 1, 3)
    assert len(tried) == 1
    monkeypatch.setattr(C, "_post_json", post)
    assert C.make_chat_client({"type": "azure-openai", **opts}).invoke([{"role": "human", "content": "hi"}]) == "ok"
    assert C.make_embedder({"type": "azure-openai", **opts}).embed(["a"]) == [[1.0]]
    base = "https://x.example/openai/deployments/d1"
    assert sent == [(f"{base}/chat/completions?api-version=2023-05-15", {"api-key": "k"}),
                    (f"{base}/embeddings?api-version=2023-05-15", {"api-key": "k"})]


@pytest.mark.parametrize("batch_size", [1, 32, 1000])
def test_embedding_hands_on_few_rows_at_a_time(batch_size):
    import pyarrow as pa

    from promptframe.operators import embed as E

    given = pa.RecordBatch.from_pydict({"k": list(range(3000)), "t": ["some words"] * 2999 + [None]})
    out = list(E._embed_mapper("t", "Vector", {"type": "hashing", "dim": 8}, batch_size)([given, given.slice(0, 0)]))
    assert max(len(b) for b in out) <= max(E.ROWS, batch_size)
    assert [k for b in out for k in b.column(0).to_pylist()] == list(range(3000))
    assert out[0].schema.names == ["k", "t", "Vector"] and out[-1].column(2)[-1].as_py() == [0.0] * 8


def test_streamed_store_rows_leave_their_best_once_a_block(spark, monkeypatch):
    """Batches of the store are held up to a bounded size, so queries leave k hits a block, not k an Arrow batch."""
    import types as kinds

    import pandas as pd

    rng = np.random.default_rng(5)
    s, q = rng.normal(size=(600, 8)), rng.normal(size=(7, 8))
    frames = [pd.DataFrame({"id": range(i, i + 60), "vector": list(s[i:i + 60])}) for i in range(0, 600, 60)]
    shared = kinds.SimpleNamespace(value=(np.arange(7), q))
    run = V._stream_mapper(shared, "id", "vector", 3, "cosine", 1.0, False, False, ("int64", "int64"))
    out = list(run(frames))
    assert len(out) == 1 and {i: g.s_id.tolist() for i, g in out[0].groupby("q_id")} == _brute_topk(q, s, 3)
    monkeypatch.setattr(V, "BATCH_VALUES", 8 * 100)
    assert [len(f) for f in run(frames)] == [21] * 5


def test_search_json_asks_for_every_row_against_all(spark, tmp_path):
    from promptframe.plans import QUERIES

    rng = np.random.default_rng(9)
    m = rng.normal(size=(251, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(None, [1.0] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["q_id"]: [h.get("id") for h in json.loads(r["hits"])] for r in QUERIES["search_json"](spark, str(tmp_path)).collect()}
    unit = np.vstack([m, np.ones(8)])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    want = {i if i < 251 else None: [int(j) if j < 251 else None for j in np.argsort(-(unit @ unit[i]), kind="stable")[:3]]
            for i in range(252)}
    assert got == want
