"""Similarity, prompt-marker and template queries over ``documents`` / ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.template import render
from ..functions.tokens import TOKEN_PATTERN
from ..operators import metaprompt as M
from ..operators.chat import chat_prompt
from ..operators.similarity import bow_counts, similarity_scores
from ..session import table
from .registry import query

_TOK = f"regexp_extract_all(lower(text), '{TOKEN_PATTERN}')"


@query("bow_counts", f"""
SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY ALL
""")
def q_bow_counts(spark, sf_dir):
    return bow_counts(table(spark, sf_dir, "documents"), "doc_id")


def _triples(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / 3).cast("long").alias("id"),
                    F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("e")),
                                 (F.pmod(F.col("doc_id"), F.lit(3)) + 1).cast("int")).alias("slot"), "text")


_SIM_SQL = f"""
WITH l AS (SELECT CAST(doc_id // 3 AS BIGINT) AS id, ['a', 'b', 'e'][doc_id % 3 + 1] AS slot, text FROM documents),
g AS (SELECT id,
        max(CASE WHEN slot = 'a' AND length(text) > 0 THEN 1 ELSE 0 END) AS a_ne,
        max(CASE WHEN slot = 'b' AND length(text) > 0 THEN 1 ELSE 0 END) AS b_ne,
        max(CASE WHEN slot = 'a' THEN text END) AS ta, max(CASE WHEN slot = 'b' THEN text END) AS tb
      FROM l GROUP BY id),
t AS (SELECT id, slot, unnest({_TOK}) AS term FROM l),
pt AS (SELECT id, term, count(*) FILTER (WHERE slot = 'a') AS na, count(*) FILTER (WHERE slot = 'b') AS nb,
              count(*) FILTER (WHERE slot = 'e') AS ne FROM t GROUP BY id, term),
s AS (SELECT id, sum(na * ne) AS ae, sum(nb * ne) AS be, sum(na * na) AS aa, sum(nb * nb) AS bb, sum(ne * ne) AS ee
      FROM pt GROUP BY id),
j AS (SELECT g.*,
        CASE WHEN coalesce(sqrt(aa::DOUBLE) * sqrt(ee::DOUBLE), 0) = 0 THEN 0.0
             ELSE ae / (sqrt(aa::DOUBLE) * sqrt(ee::DOUBLE)) END AS ca,
        CASE WHEN coalesce(sqrt(bb::DOUBLE) * sqrt(ee::DOUBLE), 0) = 0 THEN 0.0
             ELSE be / (sqrt(bb::DOUBLE) * sqrt(ee::DOUBLE)) END AS cb
      FROM g LEFT JOIN s USING (id))
"""


@query("delta_similarity", _SIM_SQL + """
SELECT id, round(ca, 9) AS cos_alpha, round(cb, 9) AS cos_beta,
  round(CASE WHEN a_ne = 0 AND b_ne = 0 THEN 0.0 WHEN a_ne = 0 THEN -1.0 WHEN b_ne = 0 THEN 1.0
       WHEN ta = tb THEN 0.0 ELSE ca - cb END, 9) AS delta
FROM j
""")
def q_delta_similarity(spark, sf_dir):
    s = similarity_scores(_triples(spark, sf_dir), "id")
    return s.select("id", F.round("cos_alpha", 9).alias("cos_alpha"), F.round("cos_beta", 9).alias("cos_beta"),
                    F.round("delta", 9).alias("delta"))


@query("compare_strings", _SIM_SQL + """
SELECT id, CASE WHEN a_ne = 0 AND b_ne = 0 THEN NULL WHEN a_ne = 0 THEN 'B' WHEN b_ne = 0 THEN 'A'
       WHEN ta = tb THEN NULL WHEN ca > cb THEN 'A' WHEN cb > ca THEN 'B' END AS winner
FROM j
""")
def q_compare_strings(spark, sf_dir):
    return similarity_scores(_triples(spark, sf_dir), "id").select("id", "winner")


# Generator responses derived from the documents: English texts come back
# inside prompt markers and a code fence, French ones with the no-change
# marker, German ones with empty markers, the rest without markers.
def _responses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lang, text = F.col("lang"), F.col("text")
    resp = (F.when(lang == "en", F.concat(F.lit("Sure.\n" + M.BEGIN_MARKER + "\n```\n"), text,
                                          F.lit("\n```\n" + M.END_MARKER + "\nDone.")))
            .when(lang == "fr", F.concat(text, F.lit("\n" + M.NO_CHANGE_MARKER)))
            .when(lang == "de", F.concat(text, F.lit(M.BEGIN_MARKER + "\n\n" + M.END_MARKER)))
            .otherwise(text))
    return d.select("doc_id", resp.alias("response"))


_RESP_SQL = f"""
SELECT doc_id, CASE
  WHEN lang = 'en' THEN 'Sure.' || chr(10) || '{M.BEGIN_MARKER}' || chr(10) || '```' || chr(10) || text || chr(10)
       || '```' || chr(10) || '{M.END_MARKER}' || chr(10) || 'Done.'
  WHEN lang = 'fr' THEN text || chr(10) || '{M.NO_CHANGE_MARKER}'
  WHEN lang = 'de' THEN text || '{M.BEGIN_MARKER}' || chr(10) || chr(10) || '{M.END_MARKER}'
  ELSE text END AS response
FROM documents
"""

_EXTRACT_SQL = f"""
CASE WHEN regexp_matches(response, '{M.PROMPT_PATTERN}') THEN
  (SELECT CASE WHEN starts_with(s, '```') AND ends_with(s, '```') THEN substr(s, 4, greatest(length(s) - 6, 0))
               ELSE s END FROM (SELECT trim(regexp_extract(response, '{M.PROMPT_PATTERN}', 1), chr(10)) AS s))
END
"""


@query("extract_prompt", f"SELECT doc_id, {_EXTRACT_SQL} AS extracted FROM ({_RESP_SQL})")
def q_extract_prompt(spark, sf_dir):
    return _responses(spark, sf_dir).select("doc_id", M.extract_updated_prompt("response").alias("extracted"))


@query("detect_no_change", f"""
SELECT doc_id, contains(response, '{M.NO_CHANGE_MARKER}') AS no_change FROM ({_RESP_SQL})
""")
def q_detect_no_change(spark, sf_dir):
    return _responses(spark, sf_dir).select("doc_id", M.detect_no_change("response").alias("no_change"))


@query("meta_step", f"""
SELECT doc_id, CASE WHEN length(ex) > 0 THEN ex ELSE response END AS new_prompt,
       NOT contains(response, '{M.NO_CHANGE_MARKER}') AS changed
FROM (SELECT doc_id, response, {_EXTRACT_SQL} AS ex FROM ({_RESP_SQL}))
""")
def q_meta_step(spark, sf_dir):
    return M.meta_result(_responses(spark, sf_dir)).select("doc_id", "new_prompt", "changed")


@query("meta_prompt_text", """
WITH u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant'),
     p AS (SELECT u.conv_id, u.turn, u.question, a.answer FROM u LEFT JOIN a USING (conv_id, turn))
SELECT conv_id, turn,
  chr(10) || '* Prompt Template' || chr(10) || '```' || chr(10) || 'You answer in the style of conversation '
  || conv_id || '.' || chr(10) || '```' || chr(10) || '* User Message' || chr(10) || '```' || chr(10) || question
  || chr(10) || '```' || chr(10) || CASE WHEN answer IS NULL THEN '* Other User Messages' ELSE '' END || chr(10)
  || CASE WHEN answer IS NULL THEN '```' || chr(10) || question || chr(10) || '```' ELSE '' END || chr(10)
  || '* Expected GPT Message' || chr(10) || '```' || chr(10) || coalesce(answer, '') || chr(10) || '```' || chr(10)
  || '* GPT Message' || chr(10) || '```' || chr(10) || '' || chr(10) || '```' || chr(10) AS user_message
FROM p
""")
def q_meta_prompt_text(spark, sf_dir):
    from ..operators.chat import chat_pairs

    p = chat_pairs(table(spark, sf_dir, "conversations"), input_col="question", output_col="answer")
    msg = M.meta_user_message(
        render("You answer in the style of conversation {conv_id}."), "question",
        F.concat(F.lit("```\n"), F.col("question"), F.lit("\n```")), "answer", F.lit(""),
        F.col("answer").isNull())
    return p.select("conv_id", "turn", msg.alias("user_message"))


TEMPLATE = "Customer {c_name} (#{c_custkey}) in segment {c_mktsegment}. Braces: {{x}}"


@query("render_template", """
SELECT c_custkey, 'Customer ' || c_name || ' (#' || c_custkey || ') in segment ' || c_mktsegment || '. Braces: {x}'
  AS text FROM customer
""")
def q_render_template(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", render(TEMPLATE).alias("text"))


HISTORY = [("Hi", "Hello!"), ("Who are you?", "An assistant.")]


@query("chat_prompt", """
SELECT c_custkey, m.msg_no, m.role, m.content FROM customer, LATERAL (
  SELECT * FROM (VALUES (0, 'system', 'You are a ' || c_mktsegment || ' analyst.'), (1, 'human', 'Hi'),
    (2, 'ai', 'Hello!'), (3, 'human', 'Who are you?'), (4, 'ai', 'An assistant.'),
    (5, 'human', 'Summarise customer ' || c_name || '.')) AS v(msg_no, role, content)) AS m
""")
def q_chat_prompt(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    p = chat_prompt(c, "You are a {c_mktsegment} analyst.", "Summarise customer {c_name}.", HISTORY)
    return p.select("c_custkey", F.posexplode("messages").alias("msg_no", "m")) \
        .select("c_custkey", F.col("msg_no").cast("int").alias("msg_no"), "m.role", "m.content")
