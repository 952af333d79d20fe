"""Chat-turn operators on a turn table ``(conv_id, turn, role, text)``.

The reference keeps chat history as a Python list of ``(human, ai)`` pairs.
Here a history is a table with one row per turn, so a conversation of any
length is spread over the cluster.  Pairing a turn with its successor is an
equi-join on ``(conv, turn + 1)``: the shuffle key includes the turn, so one
huge conversation never lands in a single task (a ``lead()`` window over the
conversation would).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids


def chat_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text", human: str = "user", ai: str = "assistant",
               input_col: str = "Input", output_col: str = "Output") -> DataFrame:
    """Each human turn with the AI turn that directly follows it (PRJ14).

    Output: ``conv, turn, Input, Output``; ``Output`` is null when the next
    turn is missing or not an AI turn.  Turns must be consecutive integers
    within a conversation (the turn table form of a chat list).
    """
    q = turns.where(F.col(role) == human).select(conv, turn, F.col(text).alias(input_col))
    a = turns.where(F.col(role) == ai).select(F.col(conv).alias("_conv"), (F.col(turn) - 1).alias("_turn"),
                                              F.col(text).alias(output_col))
    cond = q[conv].eqNullSafe(a["_conv"]) & (q[turn] == a["_turn"])     # a null id is one conversation
    return q.join(a, cond, "left").select(conv, turn, input_col, output_col)


def last_turn(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text",
              out: str = "last_text") -> DataFrame:
    """Text of the last turn of each conversation (``chatbot[-1][-1]``, PRJ13).

    ``max(turn)`` per conversation is a partial hash aggregate (a hot
    conversation costs one row per task); the text is then fetched with an
    equi-join on ``(conv, turn)``, a key without hot values.  (``max_by`` on
    the text would force a sort-based aggregate over the texts.)
    """
    last = turns.groupBy(conv).agg(F.max(turn).alias("last_turn"))
    texts = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(text).alias(out))
    # Null-safe on the conversation: a null id is one group, as in groupBy.
    cond = last[conv].eqNullSafe(texts["_conv"]) & (last["last_turn"] == texts["_turn"])
    return last.join(texts, cond).select(conv, "last_turn", out)


def chat_prompt(df: DataFrame, system_template: str, user_template: str,
                history: list[tuple[str, str]] | None = None, out: str = "messages") -> DataFrame:
    """System template + fixed history + user template, per row (PRM1).

    Produces ``array<struct<role, content>>``; history pairs are literals, the
    two templates are compiled ``concat`` expressions.
    """
    from ..functions.template import render

    def msg(r, c):
        return F.struct(F.lit(r).alias("role"), c.alias("content"))

    items = [msg("system", render(system_template))]
    for h, a in history or []:
        items += [msg("human", F.lit(h)), msg("ai", F.lit(a))]
    items.append(msg("human", render(user_template)))
    return df.withColumn(out, F.array(*items))


def sample_histories(pairs: DataFrame, num_rows=None, num_arrays: int = 5, seed: str = "0",
                     question: str = "question", output: str = "output", order_by=None,
                     out: str = "!chat_history") -> DataFrame:
    """Sample ``num_arrays`` pairs with replacement into each of ``num_rows`` rows (AGG4).

    ``num_rows`` defaults to the number of pairs.

    The reference draws with unseeded ``random.randint``; here slot ``(row, k)``
    takes pair ``md5(seed, row, k) mod n``, reproducible across retries.  The
    draw is a join on the pair position (not a broadcast: the pair table grows
    with the data), and each output row gathers exactly ``num_arrays`` items,
    so no group is unbounded.  The history is JSON (``[[q, a], ...]``), which
    ``from_json`` reads back, instead of a Python literal.
    """
    from .positional import with_pos

    spark = pairs.sparkSession
    indexed, n = with_pos(pairs.select(question, output, *(order_by or [])), order_by=order_by, return_count=True)
    if n == 0:
        return spark.createDataFrame([], f"row_id long, `{out}` string")
    num_rows = n if num_rows is None else int(num_rows)
    slots = (spark.range(num_rows)
             .select(F.col("id").alias("row_id"),
                     F.explode(F.sequence(F.lit(0), F.lit(num_arrays - 1))).alias("slot"))
             .withColumn("pos", ids.hash_index(n, "row_id", "slot", salt=seed)))
    picked = slots.join(indexed.select("pos", question, output), "pos")
    return (picked.groupBy("row_id")
            .agg(F.sort_array(F.collect_list(F.struct("slot", F.array(F.col(question), F.col(output)).alias("qa"))))
                 .alias("items"))
            .select("row_id", F.to_json(F.transform("items", lambda s: s["qa"])).alias(out)))
