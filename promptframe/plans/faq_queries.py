"""FAQ and chat-turn queries over ``conversations``.

A FAQ sheet is derived from the turn table: every user turn is a question
``Q``; the assistant turn right after it is the answer ``A``, or the no-answer
pattern when the question went unanswered; ``text`` is the ``Q: ..\\nA: ..``
pair the sheet carries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chat import chat_pairs, last_turn
from ..operators.faq import NO_ANSWER_PATTERN, faq_fix, faq_link_text
from ..session import table
from .registry import query

_PAIRS_SQL = """
WITH u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, u.turn, u.question, a.answer FROM u LEFT JOIN a USING (conv_id, turn)
"""

_SHEET_SQL = f"""
WITH p AS ({_PAIRS_SQL})
SELECT conv_id, turn, question AS Q, coalesce(answer, '{NO_ANSWER_PATTERN}') AS A,
       'Q: ' || question || chr(10) || 'A: ' || coalesce(answer, 'No information available') AS text
FROM p
"""


def faq_sheet(spark, sf_dir):
    pairs = chat_pairs(table(spark, sf_dir, "conversations"), input_col="question", output_col="answer")
    return pairs.select(
        "conv_id", "turn", F.col("question").alias("Q"),
        F.coalesce("answer", F.lit(NO_ANSWER_PATTERN)).alias("A"),
        F.concat(F.lit("Q: "), "question", F.lit("\nA: "),
                 F.coalesce("answer", F.lit("No information available"))).alias("text"))


@query("faq_fix", f"""
WITH s AS ({_SHEET_SQL}),
f AS (SELECT *, substr(md5(concat_ws(chr(1), '', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), 1, 24) AS faq_id
      FROM s)
SELECT conv_id, turn, Q, A, text, faq_id,
       'Q: ' || Q || chr(10) || 'A: ' ||
       CASE WHEN A = '{NO_ANSWER_PATTERN}'
            THEN 'For more information about `' || Q || '`, please visit the following link: [' || Q
                 || '](faq:' || faq_id || ').'
            ELSE A || ' For more details, please see the link [' || Q || '](faq:' || faq_id || ').' END AS faq_text,
       CASE WHEN starts_with(text, 'Q: ') THEN string_split(text, 'A: ')[2] ELSE text END AS rdb_text,
       CASE WHEN starts_with(text, 'Q: ') AND string_split(text, 'A: ')[2] IS NULL
            THEN 'text starts with ''Q: '' but has no ''A: ''' END AS faq_error
FROM f
""")
def q_faq_fix(spark, sf_dir):
    return faq_fix(faq_sheet(spark, sf_dir), id_cols=["conv_id", "turn"])


def _link_sql(general_sep: str, as_json: bool) -> str:
    answer = (f"CASE WHEN Output = '{NO_ANSWER_PATTERN}' THEN '关于 ' || Q || '，详见链接 [' || Q || '](faq: ' || faq_id || ')' "
              f"ELSE Output || {general_sep} || '详见链接 [' || Q || '](faq: ' || faq_id || ')' END")
    text = (f"CAST(json_object('question', Q, 'answer', {answer}) AS VARCHAR)" if as_json
            else f"'Q: ' || Q || chr(10) || 'A: ' || {answer}")
    return f"""
WITH s AS ({_SHEET_SQL}),
f AS (SELECT conv_id, turn, Q, A AS Output,
             substr(md5(concat_ws(chr(1), '', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), 1, 32) AS faq_id
      FROM s)
SELECT conv_id, turn, Q, Output, faq_id, {text} AS faq_text FROM f
"""


def _link_sheet(spark, sf_dir):
    return faq_sheet(spark, sf_dir).select("conv_id", "turn", "Q", F.col("A").alias("Output"))


@query("faq_link_text", _link_sql("' '", as_json=False))
def q_faq_link_text(spark, sf_dir):
    return faq_link_text(_link_sheet(spark, sf_dir), id_cols=["conv_id", "turn"])


@query("faq_json", _link_sql("chr(10)", as_json=True))
def q_faq_json(spark, sf_dir):
    return faq_link_text(_link_sheet(spark, sf_dir), id_cols=["conv_id", "turn"], as_json=True)


@query("chat_pairs", f"""
WITH p AS ({_PAIRS_SQL}) SELECT conv_id, turn, question AS Input, answer AS Output FROM p
""")
def q_chat_pairs(spark, sf_dir):
    return chat_pairs(table(spark, sf_dir, "conversations"))


@query("last_turn", """
SELECT conv_id, max(turn) AS last_turn, arg_max(text, turn) AS last_text
FROM conversations WHERE role = 'assistant' GROUP BY conv_id
""")
def q_last_turn(spark, sf_dir):
    return last_turn(table(spark, sf_dir, "conversations").where("role = 'assistant'"))


@query("sample_histories", f"""
WITH p AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos, question, answer FROM ({_PAIRS_SQL})),
c AS (SELECT count(*) AS n FROM p),
s AS (SELECT r.row_id, k.slot,
        CAST(('0x' || substr(md5(concat_ws(chr(1), '0', CAST(r.row_id AS VARCHAR), CAST(k.slot AS VARCHAR))), 1, 15))
             AS BIGINT) % c.n AS pos
      FROM c, range(c.n) r(row_id), range(5) k(slot))
SELECT row_id, to_json(list([question, answer] ORDER BY slot)) AS "!chat_history" FROM s JOIN p USING (pos)
GROUP BY row_id
""")
def q_sample_histories(spark, sf_dir):
    from ..operators.chat import sample_histories

    pairs = chat_pairs(table(spark, sf_dir, "conversations"), input_col="question", output_col="answer")
    return sample_histories(pairs, None, 5, seed="0", question="question", output="answer",
                            order_by=["conv_id", "turn"])
