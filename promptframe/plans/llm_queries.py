"""LLM-map queries with deterministic stand-in clients.

``md5-echo`` answers md5 of the message transcript (``role: content``
lines), so SQL can state the expected output.  Customers whose name holds
``#0000001`` make the stand-in fail: their batch falls back to one call per
row and those rows come back as ``''`` with ``status='error'``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chat import chat_prompt
from ..operators.ledger import call_report, llm_ledger, read_log
from ..operators.llm import bang_columns, call_stats, chain_batch, llm_batch
from ..operators.metaprompt import optimize_prompts
from ..operators.positional import infer_roles, project_fields
from ..session import scratch_path, table
from .registry import ORACLES, query

FAIL_ON = "#0000001"
CLIENT = {"type": "md5-echo", "fail_on": FAIL_ON}
SYSTEM = "You are a {c_mktsegment} analyst."
USER = "Summarise customer {c_name}."


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.when(F.col("c_acctbal") < 0, F.lit("skip")).otherwise(F.lit("")).alias("Skip"),
                    "c_custkey", "c_name", "c_mktsegment")


@query("llm_batch", f"""
SELECT c_custkey, c_name, c_mktsegment,
  CASE WHEN contains(t, '{FAIL_ON}') THEN '' ELSE md5(t) END AS Output,
  CASE WHEN contains(t, '{FAIL_ON}') THEN 'error' ELSE 'ok' END AS status
FROM (SELECT *, 'system: You are a ' || c_mktsegment || ' analyst.' || chr(10) || 'human: Summarise customer '
             || c_name || '.' AS t FROM customer WHERE c_acctbal >= 0)
""")
def q_llm_batch(spark, sf_dir):
    res = llm_batch(_customers(spark, sf_dir), SYSTEM, USER, CLIENT, batch_size=10,
                    keep=["c_custkey", "c_name", "c_mktsegment"])
    return res.select("c_custkey", "c_name", "c_mktsegment", "Output", "status")


@query("llm_concurrent")
def q_llm_concurrent(spark, sf_dir):
    """LLM3: the same batch with each batch's calls sent on a thread pool (4 in flight per task)."""
    res = llm_batch(_customers(spark, sf_dir), SYSTEM, USER, dict(CLIENT, concurrency=4), batch_size=10,
                    keep=["c_custkey", "c_name", "c_mktsegment"])
    return res.select("c_custkey", "c_name", "c_mktsegment", "Output", "status")


@query("test_prompt", """
SELECT conv_id, turn, text AS testing_user_prompt,
       md5('system: You are a helpful assistant.' || chr(10) || 'human: ' || coalesce(text, '')) AS output
FROM conversations WHERE role = 'user'
""")
def q_test_prompt(spark, sf_dir):
    """LLM4: one system + user prompt per row against the target model."""
    from ..operators.metaprompt import test_prompt

    users = (table(spark, sf_dir, "conversations").where(F.col("role") == "user")
             .select("conv_id", "turn", F.lit("You are a helpful assistant.").alias("system"),
                     F.col("text").alias("testing_user_prompt")))
    return test_prompt(users, "system", "testing_user_prompt", {"type": "md5-echo"}).drop("system")


@query("llm_call_stats", f"""
SELECT CASE WHEN contains(t, '{FAIL_ON}') THEN 'error' ELSE 'ok' END AS status, count(*) AS calls, true AS timed
FROM (SELECT 'system: You are a ' || c_mktsegment || ' analyst.' || chr(10) || 'human: Summarise customer '
             || c_name || '.' AS t FROM customer WHERE c_acctbal >= 0)
GROUP BY ALL
""")
def q_llm_call_stats(spark, sf_dir):
    """Calls per status; latencies vary from run to run, so only their presence is compared."""
    res = llm_batch(_customers(spark, sf_dir), SYSTEM, USER, CLIENT, batch_size=10, keep=["c_custkey"])
    stats = call_stats(res)
    return stats.select("status", "calls", ((F.col("min_ms") >= 0) & (F.col("avg_ms") >= 0)).alias("timed"))


def _ledger(spark, sf_dir, log):
    rows = _customers(spark, sf_dir).where("Skip = ''").drop("Skip")
    return llm_ledger(chat_prompt(rows, SYSTEM, USER), "messages", CLIENT, log, ["c_custkey"])


@query("llm_ledger")
def q_llm_ledger(spark, sf_dir):
    """LLM1 through the call ledger: the answers of a second run over one log, which sends nothing."""
    log = scratch_path(spark, "ledger")
    _ledger(spark, sf_dir, log)
    return _ledger(spark, sf_dir, log).select("c_custkey", "c_name", "c_mktsegment", "Output", "status")


@query("llm_ledger_calls", f"""
SELECT status, count(*) AS calls, count(*) AS keys, true AS timed, 1 AS runs
FROM (SELECT CASE WHEN contains(c_name, '{FAIL_ON}') THEN 'error' ELSE 'ok' END AS status FROM customer WHERE c_acctbal >= 0)
GROUP BY ALL
""")
def q_llm_ledger_calls(spark, sf_dir):
    """AGG5, DT3: one record a call with its own start and latency, still one after a second run."""
    log = scratch_path(spark, "ledger")
    for _ in range(2):
        _ledger(spark, sf_dir, log)
    times = call_report(spark, log).select("status", ((F.col("min_ms") >= 0) & (F.col("seconds") >= 0)).alias("timed"))
    keys = (read_log(spark, log).where("started_at IS NOT NULL").groupBy("status", "call_key", "run").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("status").agg(F.sum("n").alias("calls"), F.countDistinct("call_key").alias("keys"),
                                   F.countDistinct("run").alias("runs")))
    return keys.join(times, "status").select("status", "calls", "keys", "timed", "runs")


@query("bang_columns", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def q_bang_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("props").alias("!props"))
    return bang_columns(e).select("event_id", "event_type", F.col("props.k").alias("k"))


@query("bang_literals", """
SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_custkey END AS id, CASE WHEN c_custkey % 3 < 2 THEN 'it''s ' || c_name END AS said,
       CASE WHEN c_custkey % 3 = 0 THEN true END AS first_flag, CASE WHEN c_custkey % 50 = 3 AND c_custkey % 3 = 1 THEN 1.5 END AS late,
       c_custkey % 3 = 2 AS wrong
FROM customer
""")
def q_bang_literals(spark, sf_dir):
    """Cells spelled as Python literals, as JSON and as neither, with a key that few rows have."""
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    third = F.col("c_custkey") % 3
    late = F.when(F.col("c_custkey") % 50 == 3, F.lit(', "late": 1.5')).otherwise(F.lit(""))
    cell = (F.when(third == 0, F.concat(F.lit("{'id': "), key, F.lit(", 'said': 'it\\'s ' \""), name, F.lit("\", 'flags': (True, None,),}")))
            .when(third == 1, F.concat(F.lit('{"id": '), key, F.lit(', "said": "it\'s '), name, F.lit('", "flags": []'), late, F.lit("}")))
            .otherwise(F.concat(F.lit("{'id': id_of("), key, F.lit(")}"))))
    read = bang_columns(table(spark, sf_dir, "customer").select("c_custkey", cell.alias("!cell")), error_col="errors")
    return read.select("c_custkey", F.col("cell.id").alias("id"), F.col("cell.said").alias("said"),
                       F.get("cell.flags", F.lit(0)).alias("first_flag"), F.col("cell.late").alias("late"),
                       F.col("errors").isNotNull().alias("wrong"))


@query("infer_roles", """
SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name || '|' || n_regionkey AS val, 'n_nationkey' AS key_field,
       'n_name, n_regionkey' AS value_fields FROM (SELECT n_nationkey, n_name, n_regionkey FROM nation)
""")
def q_infer_roles(spark, sf_dir):
    """Key and value fields of a table by its columns alone (PRJ7), and the rows under them."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    key, values = infer_roles(n)
    rows = project_fields(n, f"{key}, {values}")
    return rows.select(F.col(key).cast("string").alias("key"), F.concat_ws("|", *[F.col(v).cast("string") for v in rows.columns[1:]]).alias("val"),
                       F.lit(key).alias("key_field"), F.lit(values).alias("value_fields"))


@query("chain_batch", """
SELECT event_id, event_type AS input, k,
  md5(to_json(struct_pack(event_id := event_id, input := event_type, props := struct_pack(k := k)))) AS output
FROM (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
""")
def q_chain_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("input"),
                                              F.col("props").alias("!props"))
    res = chain_batch(e, {"type": "md5-json"}, batch_size=50)
    return res.select("event_id", "input", F.col("props.k").alias("k"), "output")


META_SYSTEM = "Improve the prompt template so the GPT message matches the expected message."


# With the stand-ins the loop is deterministic: round 1 tests the prompt and
# the generator appends its suffix (adopted, output cleared); round 2 tests the
# new prompt and the generator reports no change; then no row is active.
@query("optimize_prompts", """
WITH u AS (SELECT conv_id, turn, text AS q FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id, turn - 1 AS turn, text AS ans FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, 'You are a helpful assistant. Be concise.' AS current_system_prompt, q AS testing_user_prompt,
       coalesce(ans, '') AS expect_output,
       md5('system: You are a helpful assistant. Be concise.' || chr(10) || 'human: ' || coalesce(q, ''))
         AS current_output,
       false AS changed
FROM u LEFT JOIN a USING (conv_id, turn)
""")
def q_optimize_prompts(spark, sf_dir):
    from ..operators.chat import chat_pairs

    p = chat_pairs(table(spark, sf_dir, "conversations"), input_col="testing_user_prompt", output_col="expect_output")
    prompts = p.select("conv_id", "turn", F.lit("You are a helpful assistant.").alias("current_system_prompt"),
                       "testing_user_prompt", F.coalesce("expect_output", F.lit("")).alias("expect_output"),
                       F.lit(None).cast("string").alias("current_output"))
    return optimize_prompts(prompts, "turn", {"type": "append-suffix"}, {"type": "md5-echo"}, META_SYSTEM,
                            iterations=3)

ORACLES["llm_concurrent"] = ORACLES["llm_ledger"] = ORACLES["llm_batch"]
