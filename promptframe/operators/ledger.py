"""Calls that outlive their task: a record for each call, written as the calls end (AGG5, DT3, LLM1-LLM3).

``run_logged`` sends every row of a table ``(key, payload)`` to a worker function and keeps one
record a call: key, run, attempt, status, output, error, start and its own elapsed time.  Tasks write the
records themselves, ``flush`` calls at a time and at the latest when an error ends them, to files
below the shared log folder.  A task that Spark starts again reads the files of the tries before it and a new run
leaves out the keys of the whole log (an anti-join), so a call whose record stands is not sent
again.  Lost with an executor are only records not yet written: those calls, at most ``flush`` a
task, are sent once more and then have two records.

``llm_ledger`` is the batch call on top of it.  Requests are written down first, with a digest of the
row's key, the message and the client as the call's key; equal requests are one call.
Answers come back by a join on that key; keys that very many rows share are salted.
"""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, spread
from ..sources.shared import list_files, open_fs, open_whole, qualified

LOG = ("call_key string, run string, task int, attempt int, status string, output string, error string, "
       "started_at timestamp, elapsed_ms long")
_ARROW = pa.schema([("call_key", pa.string()), ("run", pa.string()), ("task", pa.int32()), ("attempt", pa.int32()),
                    ("status", pa.string()), ("output", pa.string()), ("error", pa.string()),
                    ("started_at", pa.timestamp("us", tz="UTC")), ("elapsed_ms", pa.int64())])
#: Rows that one task of the answer join takes of one call key, about.
ROWS_PER_SALT = 100_000
#: Client options that name no different call.
_UNNAMED = ("api_key", "token", "concurrency", "request_timeout", "max_retries")


def _finished(folder: str, keep_errors: bool) -> set[str]:
    """Keys that an earlier try of this task has recorded."""
    out: set[str] = set()
    for f in list_files(folder, ".parquet"):
        fs, inner = open_fs(f)
        t = pq.read_table(inner, columns=["call_key", "status"], filesystem=fs).to_pydict()
        out |= {k for k, s in zip(t["call_key"], t["status"]) if s == "ok" or keep_errors}
    return out


def logged_calls(items, work, folder: str, run: str, task: int, attempt: int, flush: int, fail: bool,
                 concurrency: int = 1):
    """Send ``(key, payload)`` items to ``work(key, payload)`` and record each; yields (sent, errors, resumed).

    With ``fail`` the first error stops the task, after the records of everything that had ended are
    written; such errors are sent again by the next try, others count as finished.
    """
    done = _finished(folder, keep_errors=not fail)

    def call(item):
        key, payload = item
        start, t0 = time.time(), time.perf_counter()
        status, output, error = "ok", None, None
        try:
            output = work(key, payload)
        except Exception as e:  # noqa: BLE001 - recorded, raised below when asked to
            status, error = "error", f"{type(e).__name__}: {e}"
        return {"call_key": key, "run": run, "task": task, "attempt": attempt, "status": status, "output": output,
                "error": error, "started_at": int(start * 1e6),
                "elapsed_ms": int((time.perf_counter() - t0) * 1000)}

    def send(chunk, pool):
        records = []
        try:
            for i in range(0, len(chunk), concurrency):
                part = chunk[i:i + concurrency]
                records += pool.map(call, part) if concurrency > 1 else map(call, part)
                if fail and any(r["status"] == "error" for r in records):
                    break
        finally:  # also when the worker is told to stop in the middle of a chunk
            if records:
                with open_whole(f"{folder}/{attempt:04d}-{uuid.uuid4().hex[:12]}.parquet") as f:
                    pq.write_table(pa.Table.from_pylist(records, _ARROW), f)
        wrong = [r["error"] for r in records if r["status"] == "error"]
        if fail and wrong:
            raise RuntimeError(f"call failed: {wrong[0]}")
        return len(records), len(wrong)

    chunk: list = []
    resumed = 0
    with ThreadPoolExecutor(max(concurrency, 1)) as pool:
        for key, payload in items:
            if key in done:
                resumed += 1
                continue
            chunk.append((key, payload))
            if len(chunk) == flush:
                yield (*send(chunk, pool), resumed)
                chunk, resumed = [], 0
        if chunk or resumed:
            yield (*(send(chunk, pool) if chunk else (0, 0)), resumed)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """Every record of the log, one row a call that was sent."""
    return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(_folder(spark, log))


def _folder(spark: SparkSession, log: str) -> str:
    path = qualified(spark, log.rstrip("/"))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).mkdirs(p)
    return path


def answers(spark: SparkSession, log: str) -> DataFrame:
    """One row a call key: its last good record, or its last one where there is none."""
    newest = F.struct(F.col("status") == "ok", "started_at", "run", "task", "attempt")
    return (read_log(spark, log).groupBy("call_key")
            .agg(F.max_by(F.struct("status", "output", "error", "elapsed_ms"), newest).alias("r"),
                 F.count(F.lit(1)).alias("times_sent"))
            .select("call_key", "r.*", "times_sent"))


def run_logged(todo: DataFrame, make_work, log: str, flush: int = 20, on_error: str = "blank",
               retry_errors: bool = False, concurrency: int = 1) -> dict:
    """Send the rows of ``todo`` (call_key string, payload string; keys distinct) that the log has not finished.

    ``make_work()`` builds ``work(key, payload) -> str | None`` once a task.  ``on_error='fail'`` raises at the
    first error and sends recorded errors again in the next run; ``'blank'`` records them and goes on,
    and sends them again only with ``retry_errors``.  Returns the counts ``sent``, ``errors`` and ``left_out``
    of this run.
    """
    if on_error not in ("blank", "fail"):
        raise ValueError("on_error must be 'blank' or 'fail'")
    if int(flush) < 1 or int(concurrency) < 1:
        raise ValueError("flush and concurrency must be >= 1")
    spark = todo.sparkSession
    ship_package(spark)
    folder, run = _folder(spark, log), f"{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
    fail = on_error == "fail"
    finished = read_log(spark, log)
    if fail or retry_errors:
        finished = finished.where("status = 'ok'")
    # A written table: a task that is started again sees the rows of the try before it.
    path = scratch_path(spark, "calls-todo")
    todo.select("call_key", "payload").join(finished.select("call_key"), "call_key", "left_anti").write.parquet(path)
    pending = spread(spark.read.schema("call_key string, payload string").parquet(path))

    def send(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        task, work = ctx.partitionId(), make_work()
        items = (kv for b in batches for kv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for sent, errors, resumed in logged_calls(items, work, f"{folder}/{run}/{task:06d}", run, task,
                                                  ctx.attemptNumber(), int(flush), fail, int(concurrency)):
            yield pa.RecordBatch.from_pydict({"sent": pa.array([sent], pa.int64()), "errors": pa.array([errors], pa.int64()),
                                              "resumed": pa.array([resumed], pa.int64())})

    total = (pending.mapInArrow(send, "sent long, errors long, resumed long")
             .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sent", "errors", "resumed")]).first())
    return total.asDict()


def llm_ledger(df: DataFrame, input_col: str, client: dict, log: str, keys: list[str], on_error: str = "blank",
               out: str = "Output", flush: int = 20, retry_errors: bool = False) -> DataFrame:
    """``llm_map`` through a ledger: ``df`` with ``out``, ``status``, ``error``, ``elapsed_ms`` and ``call_key``.

    ``keys`` tell requests apart together with the message in ``input_col`` (a string, null as empty, or
    role / content messages) and the client's options but for secrets and transport; rows
    equal in all of them share one call.  Calls run at once (``client['concurrency']`` in flight a task),
    the result is a plan over written tables.  A run over the same ``log`` sends only what it lacks.
    An empty table sends nothing; columns of ``df`` named like the results are replaced.
    """
    spark = df.sparkSession
    results = [out, "status", "error", "elapsed_ms", "call_key"]
    message = F.col(f"`{input_col}`")
    if dict(df.dtypes)[input_col] == "string":
        message = F.array(F.struct(F.lit("human").alias("role"), F.coalesce(message, F.lit("")).alias("content")))
    payload = F.coalesce(F.to_json(message, {"ignoreNullFields": "false"}), F.lit('[{"role":"human","content":""}]'))
    named = json.dumps({k: v for k, v in client.items() if k not in _UNNAMED}, sort_keys=True)
    key = F.sha2(F.to_json(F.struct(F.lit(named).alias("c"), F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k"),
                                    payload.alias("p"))), 256)
    own = [c for c in df.columns if c not in results]
    path = scratch_path(spark, "requests")
    (df.select(key.alias("call_key"), payload.alias("payload"),
               F.struct(F.lit(True).alias("r"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("row"))
     .write.parquet(path))
    requests = spark.read.parquet(path)
    opts = dict(client)

    def make_work():
        from promptframe.operators.clients import make_chat_client

        model = make_chat_client(opts)
        return lambda key, payload: model.invoke(json.loads(payload))

    calls = requests.groupBy("call_key").agg(F.any_value("payload").alias("payload"))
    run_logged(calls, make_work, log, flush, on_error, retry_errors, int(client.get("concurrency", 1)))

    # Few keys can have that many rows: rows / ROWS_PER_SALT at most.
    hot = (requests.groupBy("call_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_PER_SALT)
           .select(F.col("call_key").alias("hot_key"), F.ceil(F.col("n") / ROWS_PER_SALT).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    left = (requests.select("call_key", "row").join(F.broadcast(hot), F.col("call_key") == F.col("hot_key"), "left")
            .withColumn("salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")))
    right = (answers(spark, log).join(F.broadcast(hot), F.col("call_key") == F.col("hot_key"), "left")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("hot_key", "salts"))
    joined = left.join(right, ["call_key", "salt"], "left")
    return joined.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(own)],
                         F.coalesce("output", F.lit("")).alias(out), "status", "error", "elapsed_ms", "call_key")


def call_report(spark: SparkSession, log: str) -> DataFrame:
    """Per status: calls, distinct keys, seconds in calls, least, mean, median and 95% latency in ms."""
    return read_log(spark, log).groupBy("status").agg(
        F.count(F.lit(1)).alias("calls"), F.approx_count_distinct("call_key").alias("keys"),
        (F.sum("elapsed_ms") / 1000).alias("seconds"), F.min("elapsed_ms").alias("min_ms"),
        F.avg("elapsed_ms").alias("avg_ms"), F.percentile_approx("elapsed_ms", [0.5, 0.95]).alias("p50_p95_ms"))
