"""Bag-of-words similarity (AGG3 / SIM1-SIM3).

The reference fits a ``CountVectorizer`` on three strings (alpha, beta,
expected) and compares the cosine of alpha and of beta to expected.  Here a
whole table of triples is scored in two aggregations:

* tokens are exploded once and counted per ``(triple, term)`` with one count
  per slot (partial aggregation, so a huge text costs one row per term per
  task before the shuffle);
* dot products and squared norms are summed per triple.

Texts are never put in an aggregation buffer (that would force a
sort-based aggregate over the texts).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import tokens
from ..session import spread


#: Characters of text in one task: its terms, counted there, take some 30 times as many bytes.
PART_CHARS = 8 << 20


def bow_counts(df: DataFrame, key: str, text: str = "text", term: str = "term", count: str = "n") -> DataFrame:
    """Term counts per text: ``key, term, n`` (CountVectorizer's matrix, sparse)."""
    return (spread(df.select(key, text)).select(key, F.explode(tokens(text)).alias(term))
            .groupBy(key, term).agg(F.count(F.lit(1)).alias(count)))


def triples_long(df: DataFrame, id_col: str, alpha: str, beta: str, expected: str) -> DataFrame:
    """``(id, alpha, beta, expected)`` -> long form ``(id, slot, text)``."""
    return df.select(id_col, F.explode(F.array(
        F.struct(F.lit("a").alias("slot"), F.col(alpha).alias("text")),
        F.struct(F.lit("b").alias("slot"), F.col(beta).alias("text")),
        F.struct(F.lit("e").alias("slot"), F.col(expected).alias("text")))).alias("_s")) \
        .select(id_col, "_s.slot", "_s.text")


def similarity_scores(long: DataFrame, id_col: str = "id", slot: str = "slot", text: str = "text") -> DataFrame:
    """Cosines of alpha and beta to expected, per triple, with the guards.

    ``long`` has one row per (triple, slot) with slot in ``a``, ``b``, ``e``;
    a missing slot is an empty text.  Output: ``id, cos_alpha, cos_beta,
    delta, winner`` where

    * alpha and beta both empty: delta 0, winner null;
    * alpha empty: delta -1, winner ``B``; beta empty: +1, ``A``;
    * otherwise ``delta = cos_alpha - cos_beta`` (a zero vector has cosine 0)
      and the winner is the larger cosine, null on a tie.

    The reference also returns 0 / null when alpha equals beta; that needs no
    test here: equal texts have equal count vectors, so both cosines are the
    same double.

    One scan: each text explodes into its tokens plus, when it is non-empty,
    one ``""`` marker (never a token, tokens have 2+ characters) that carries
    the emptiness guard through the same two aggregations.  ``explode_outer``
    keeps a triple whose texts are all empty.
    """
    s, t = F.col(slot), F.col(text)
    none = F.array().cast("array<string>")
    marker = F.when(F.coalesce(F.length(t) > 0, F.lit(False)), F.array(F.lit(""))).otherwise(none)
    terms = F.concat(F.coalesce(tokens(text), none), marker)
    # The texts are hash-partitioned by triple once (a triple holds at most three
    # texts); both aggregations below are keyed by the triple and need no other
    # shuffle, so term rows never cross the network.  The number of partitions grows with the text, so what
    # a task holds does not; given by number, they are not merged again.
    texts = long.select(id_col, slot, text)
    chars = texts.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    parts = max(long.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / PART_CHARS))
    per_term = (texts.repartition(parts, id_col)
                .select(id_col, slot, F.explode_outer(terms).alias("_term"))
                .groupBy(id_col, "_term").agg(
                    F.count_if(s == "a").alias("_na"), F.count_if(s == "b").alias("_nb"),
                    F.count_if(s == "e").alias("_ne")))
    na, nb, ne, term = F.col("_na"), F.col("_nb"), F.col("_ne"), F.col("_term")
    word = term.isNotNull() & (term != "")
    j = per_term.groupBy(id_col).agg(
        F.coalesce(F.max(F.when(term == "", na)), F.lit(0)).alias("_a"),
        F.coalesce(F.max(F.when(term == "", nb)), F.lit(0)).alias("_b"),
        F.sum(F.when(word, na * ne)).alias("_ae"), F.sum(F.when(word, nb * ne)).alias("_be"),
        F.sum(F.when(word, na * na)).alias("_aa"), F.sum(F.when(word, nb * nb)).alias("_bb"),
        F.sum(F.when(word, ne * ne)).alias("_ee"))

    def cos(dot, n1):
        den = F.sqrt(F.col(n1).cast("double")) * F.sqrt(F.col("_ee").cast("double"))
        return F.when(F.coalesce(den, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.col(dot) / den)

    ca, cb = cos("_ae", "_aa"), cos("_be", "_bb")
    a_empty, b_empty = F.col("_a") == 0, F.col("_b") == 0
    delta = (F.when(a_empty & b_empty, F.lit(0.0)).when(a_empty, F.lit(-1.0)).when(b_empty, F.lit(1.0))
             .otherwise(ca - cb))
    winner = (F.when(a_empty & b_empty, F.lit(None).cast("string")).when(a_empty, F.lit("B")).when(b_empty, F.lit("A"))
              .when(ca > cb, F.lit("A")).when(cb > ca, F.lit("B")))
    return j.select(id_col, ca.alias("cos_alpha"), cb.alias("cos_beta"), delta.alias("delta"), winner.alias("winner"))


def delta_similarities(df: DataFrame, id_col: str, alpha: str = "alpha", beta: str = "beta",
                       expected: str = "expected") -> DataFrame:
    """SIM2 on a wide table of triples: ``id, delta``."""
    return similarity_scores(triples_long(df, id_col, alpha, beta, expected), id_col).select(id_col, "delta")


def compare_strings(df: DataFrame, id_col: str, alpha: str = "alpha", beta: str = "beta",
                    expected: str = "expected") -> DataFrame:
    """SIM3 on a wide table of triples: ``id, winner`` (``'A'``, ``'B'`` or null)."""
    return similarity_scores(triples_long(df, id_col, alpha, beta, expected), id_col).select(id_col, "winner")
