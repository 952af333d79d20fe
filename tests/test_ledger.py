"""Calls recorded one by one: what a failure leaves is not sent again."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from promptframe.operators.ledger import answers, call_report, llm_ledger, logged_calls, read_log, run_logged
from promptframe.session import scratch_path
from promptframe.sources.shared import list_files, open_fs, open_whole, read_bytes
from promptframe.sources.staged import commit_vectors, stage_vectors


def _try(items, work, folder, attempt, **options):
    out = []
    for c in logged_calls(items, work, folder, "r", 0, attempt, options.get("flush", 3), options.get("fail", True),
                          options.get("concurrency", 1)):
        out.append(c)
    return [sum(x) for x in zip(*out)] if out else [0, 0, 0]


@pytest.mark.parametrize("concurrency", [1, 4])
@pytest.mark.parametrize("flush", [1, 3, 100])
def test_second_try_sends_only_what_the_first_did_not_finish(tmp_path, flush, concurrency):
    items, sent, broken = [(f"k{i}", str(i)) for i in range(20)], Counter(), {"k11"}

    def work(key, payload):
        sent[key] += 1
        if key in broken:
            raise RuntimeError("lost")
        return payload * 2

    with pytest.raises(RuntimeError, match="lost"):
        _try(iter(items), work, str(tmp_path / "t"), 0, flush=flush, concurrency=concurrency)
    before = Counter(sent)
    assert before["k0"] == 1 and before["k19"] == 0
    broken.clear()
    n, errors, resumed = _try(iter(items), work, str(tmp_path / "t"), 1, flush=flush, concurrency=concurrency)
    assert errors == 0 and n + resumed == 20 and resumed == len(before) - 1
    assert {k: v for k, v in sent.items() if v > 1} == {"k11": 2}


def test_errors_kept_or_sent_again(tmp_path):
    def work(key, payload):
        raise ValueError(payload)

    assert _try([("a", "1"), ("b", "2")], work, str(tmp_path / "t"), 0, fail=False) == [2, 2, 0]
    assert _try([("a", "1"), ("b", "2")], work, str(tmp_path / "t"), 1, fail=False) == [0, 0, 2]
    assert _try([], work, str(tmp_path / "none"), 0) == [0, 0, 0]


def test_job_failure_resumes_by_the_log(spark, tmp_path):
    log, marks = scratch_path(spark, "t-log"), str(tmp_path)
    todo = spark.range(60, numPartitions=3).select(F.concat(F.lit("k"), "id").alias("call_key"), F.col("id").cast("string").alias("payload"))

    def worker(broken):
        def make():
            def work(key, payload):
                import uuid

                open(f"{marks}/{key}-{uuid.uuid4().hex}", "w").close()
                if key in broken:
                    raise RuntimeError("planted")
                return f"a{payload}"
            return work
        return make

    with pytest.raises(Exception, match="planted"):
        run_logged(todo, worker({"k7", "k33"}), log, flush=1, on_error="fail")
    first = read_log(spark, log).where("status = 'ok'").count()
    got = run_logged(todo, worker(set()), log, flush=1, on_error="fail")
    assert got["errors"] == 0 and got["sent"] == 60 - first
    sends = Counter(f.rsplit("/", 1)[1].split("-")[0] for f in list_files(marks, ""))
    assert len(sends) == 60 and {k for k, n in sends.items() if n > 1} <= {"k7", "k33"}
    back = {r["call_key"]: r["output"] for r in answers(spark, log).collect()}
    assert back == {f"k{i}": f"a{i}" for i in range(60)}
    assert run_logged(todo, worker(set()), log)["sent"] == 0


def test_ledger_edges(spark):
    client = {"type": "md5-echo", "fail_on": "bad", "concurrency": 2}
    df = spark.createDataFrame([(1, "x", "p"), (1, "x", "p"), (2, None, "q"), (None, "bad", None), (3, "", "r")],
                               "id int, q string, `a.b` string")
    log = scratch_path(spark, "t-edges")
    got = llm_ledger(df, "q", client, log, ["id"])
    assert got.columns == ["id", "q", "a.b", "Output", "status", "error", "elapsed_ms", "call_key"]
    rows = got.collect()
    assert len(rows) == 5 and sorted(r["status"] for r in rows) == ["error", "ok", "ok", "ok", "ok"]
    bad = next(r for r in rows if r["q"] == "bad")
    assert bad["Output"] == "" and "stub failure" in bad["error"]
    assert len({r["call_key"] for r in rows}) == 4 and read_log(spark, log).count() == 4  # the repeated row is one call
    again = llm_ledger(df, "q", dict(client, fail_on=None), log, ["id"])   # another client: other calls
    assert {r["status"] for r in again.collect()} == {"ok"} and read_log(spark, log).count() == 8
    llm_ledger(df, "q", client, log, ["id"], retry_errors=True)
    assert read_log(spark, log).count() == 9
    assert {r["status"]: r["calls"] for r in call_report(spark, log).collect()} == {"ok": 7, "error": 2}
    none = scratch_path(spark, "t-none")
    assert llm_ledger(df.limit(0), "q", client, none, ["id"]).count() == 0 and read_log(spark, none).count() == 0
    with pytest.raises(Exception, match="stub failure"):
        llm_ledger(df, "q", client, scratch_path(spark, "t-fail"), ["id"], on_error="fail")


def test_hot_key_answers_are_salted(spark, monkeypatch):
    monkeypatch.setattr("promptframe.operators.ledger.ROWS_PER_SALT", 10)
    df = spark.range(300).select(F.when(F.col("id") < 100, 0).otherwise(F.col("id")).alias("k"),
                                 F.when(F.col("id") < 100, "hot").otherwise("m").alias("q"))
    got = llm_ledger(df, "q", {"type": "md5-echo"}, scratch_path(spark, "t-hot"), ["k"])
    assert got.count() == 300 and got.where("status = 'ok'").groupBy("k").count().where("count = 100").count() == 1


def test_staged_store_holds_every_record_once(spark):
    df = spark.range(101, numPartitions=3).select(
        F.concat(F.lit("v"), "id").alias("id"), F.array(F.col("id").cast("float")).alias("vector"),
        F.create_map(F.lit("n"), F.col("id").cast("string"), F.lit("none"), F.lit(None).cast("string")).alias("metadata"))
    staged, path = scratch_path(spark, "t-staged"), scratch_path(spark, "t-store")
    store = {"type": "jsonl-folder", "path": path, "append": True}
    stage_vectors(df, staged, batch_size=10)
    with pytest.raises(Exception, match="stub failure"):
        commit_vectors(spark, staged, dict(store, fail_on="2"))
    part = len(list_files(path, ".json"))
    sent, rows = commit_vectors(spark, staged, store)
    assert rows == 101 and 0 < sent == 12 - part
    assert commit_vectors(spark, staged, store) == (0, 101)
    got = [json.loads(x) for f in list_files(path, ".json") for x in read_bytes(f).decode().splitlines()]
    assert Counter(r["id"] for r in got) == Counter(f"v{i}" for i in range(101))
    assert all(r["metadata"] == {"n": r["id"][1:], "none": None} for r in got)
    empty = scratch_path(spark, "t-staged-empty")
    stage_vectors(df.limit(0), empty)
    assert commit_vectors(spark, empty, store) == (0, 0)
    with pytest.raises(ValueError, match="id"):
        stage_vectors(df.drop("id"), scratch_path(spark, "t-x"))


def test_shared_files(tmp_path):
    with pytest.raises(ValueError, match="nosuch"):
        open_fs("nosuch://host/folder/x")
    with pytest.raises(RuntimeError):
        with open_whole(f"file:{tmp_path}/d/x.bin") as f:
            f.write(b"half")
            raise RuntimeError
    assert list_files(f"file:{tmp_path}/d", ".bin") == [] and list((tmp_path / "d").iterdir()) == []
    with open_whole(f"file://{tmp_path}/d/e/x.bin") as f:
        f.write(b"whole")
    assert list_files(f"file://{tmp_path}/d", ".bin") == [f"file://{tmp_path}/d/e/x.bin"]
    assert read_bytes(f"{tmp_path}/d/e/x.bin") == b"whole"
    assert list_files(f"{tmp_path}/missing", "") == []
