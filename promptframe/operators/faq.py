"""FAQ sheet templating (FAQ1-FAQ3): one ``select``, no Python per row.

The reference runs ``DataFrame.apply(axis=1)`` with ``str.format``.  Here the
templates compile to ``concat`` expressions, the id is a digest of the row key
(deterministic under task retry), and the ``Q: ... A: `` cut is a literal
split.  Where the reference raises for the whole sheet (a ``Q:`` text without
``A: ``), the row gets a null ``rdb_text`` and a ``faq_error`` message.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.template import render
from ..functions.text import split_part_py

# Default field names, pattern and templates of the FAQ tab.
NO_ANSWER_PATTERN = "<NO ANSWER/>"
NO_ANSWER_TEMPLATE = ("For more information about `{question}`, please visit the following link: "
                      "[{question}](faq:{faq_id}).")
GENERAL_TEMPLATE = "{output} For more details, please see the link [{question}](faq:{faq_id})."

# Templates of the two offline FAQ link scripts (Chinese link
# text; ``faq: {id}`` with a space; the JSON variant puts a newline first).
LINK_NO_ANSWER_TEMPLATE = "关于 {question}，详见链接 [{question}](faq: {faq_id})"
LINK_GENERAL_TEMPLATE = "{output} 详见链接 [{question}](faq: {faq_id})"
LINK_JSON_GENERAL_TEMPLATE = "{output}\n详见链接 [{question}](faq: {faq_id})"


def _require(df: DataFrame, cols):
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Error processing data: missing column(s) {missing}")


def _answer(question, output, faq_id, text, pattern, no_answer_template, general_template):
    values = {"question": question, "output": output, "faq_id": faq_id, "text": text}
    return (F.when(output == F.lit(pattern), render(no_answer_template, values))
            .otherwise(render(general_template, values)))


def faq_fix(df: DataFrame, question_field: str = "Q", summary_field: str = "A", qa_field: str = "text",
            faq_id_field: str = "faq_id", faq_text_field: str = "faq_text", rdb_text_field: str = "rdb_text",
            no_answer_pattern: str = NO_ANSWER_PATTERN, no_answer_template: str = NO_ANSWER_TEMPLATE,
            general_template: str = GENERAL_TEMPLATE, id_cols: list[str] | None = None,
            error_field: str = "faq_error") -> DataFrame:
    """Add ``faq_id``, ``faq_text``, ``rdb_text`` (FAQ1)."""
    _require(df, [question_field, summary_field, qa_field])
    q, out, text = F.col(question_field), F.col(summary_field), F.col(qa_field)
    faq_id = ids.object_id(*(id_cols or [question_field, summary_field, qa_field]))
    staged = df.withColumn(faq_id_field, faq_id)
    fid = F.col(faq_id_field)
    answer = _answer(q, out, fid, text, no_answer_pattern, no_answer_template, general_template)
    is_qa = F.startswith(text, F.lit("Q: "))
    piece = split_part_py(text, "A: ", 1)
    return staged.select(
        "*",
        F.concat(F.lit("Q: "), F.coalesce(q.cast("string"), F.lit("")), F.lit("\nA: "), answer).alias(faq_text_field),
        F.when(is_qa, piece).otherwise(text).alias(rdb_text_field),
        F.when(is_qa & piece.isNull(), F.lit("text starts with 'Q: ' but has no 'A: '")).alias(error_field),
    )


def faq_link_text(df: DataFrame, question_field: str = "Q", output_field: str = "Output",
                  id_cols: list[str] | None = None, as_json: bool = False,
                  no_answer_pattern: str = NO_ANSWER_PATTERN) -> DataFrame:
    """Link-text variants (FAQ2, FAQ3): 32-hex id and ``Q: ..\\nA: ..`` or JSON.

    ``as_json`` emits ``{"question": .., "answer": ..}`` with non-ASCII kept
    (compact separators, unlike ``json.dumps``' default spacing).
    """
    _require(df, [question_field, output_field])
    q, out = F.col(question_field), F.col(output_field)
    staged = df.withColumn("faq_id", ids.hex_id(*(id_cols or [question_field, output_field]), length=32))
    general = LINK_JSON_GENERAL_TEMPLATE if as_json else LINK_GENERAL_TEMPLATE
    answer = _answer(q, out, F.col("faq_id"), F.lit(None), no_answer_pattern, LINK_NO_ANSWER_TEMPLATE, general)
    if as_json:
        text = F.to_json(F.struct(q.cast("string").alias("question"), answer.alias("answer")))
    else:
        text = F.concat(F.lit("Q: "), F.coalesce(q.cast("string"), F.lit("")), F.lit("\nA: "), answer)
    return staged.withColumn("faq_text", text)
