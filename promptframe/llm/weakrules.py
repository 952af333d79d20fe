"""Operator 12: quality rules as weak supervision.

Every rule looks at a document's counts and votes good (1), bad (-1) or abstains (0).  No rule decides by
itself: expectation-maximisation over all documents estimates how often each rule is right about good
and about bad documents, and a document is kept when the posterior probability that it is good reaches
``KEEP``.  Documents that fail the base rules are never kept; they take part in the estimate all the same,
as examples that the rules disagree about.

The estimate is exact and cheap: documents with the same votes are one pattern, there are at most
3 ** rules patterns whatever the input, and the driver gets their counts.  Counting reads every
text once, block by block on dictionary indices (:mod:`wordblocks`), and the small table of counts is
written before it is used twice.

Estimation: classes with prior ``P(good)``; a vote, given that the rule does not abstain, is right with a
probability of its own for each class, and abstaining says nothing.  Starts are ``START`` for every
rule, pseudo-counts of ``WEIGHT`` votes hold them there without evidence, and a rule never counts as
worse than a coin, so the classes cannot change places.

Defined results: a null text has no words, fails and is not kept; null and repeated keys are rows like any
other; equal texts get equal verdicts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptframe.session import ship_package

from .common import materialise
from .wordblocks import SPACES, Words, row_sums, split_lines, split_words, text_slices

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
KEEP = 0.5
START, WEIGHT, ROUNDS, SETTLED = 0.8, 4.0, 200, 1e-9
PRIOR = 0.8

_WORD = SPACES.replace("[", "[^", 1)
_SYMBOLS = r"[#*$%&|<>]"
#: A word with a letter or with a character beyond ASCII; a word of digits; a line's closing mark.
_LETTER, _DIGITS, _CLOSED = r"[A-Za-z\x{80}-\x{10FFFF}]", r"^[0-9][0-9.,:/-]*$", r"[.!?:;\"')\]][\x20\x09-\x0D]*$"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines",
          "n_letter_words", "n_number_words", "n_distinct_words", "n_top_word", "n_capital_words")


def _flags(dictionary: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(dictionary, pattern).to_numpy(zero_copy_only=False).astype(bool)


def _repeated(words: Words, row: np.ndarray, width: int = 3) -> np.ndarray:
    """Which words stand in a window of ``width`` words that its text has at least twice."""
    n = max(0, len(words.ids) - width + 1)
    out = np.zeros(len(words.ids), bool)
    place = np.flatnonzero(row[:n] == row[width - 1:]) if n else np.zeros(0, np.int64)
    if not len(place):
        return out
    # A window's number: first word with its row, then one word more at a time, so that numbers stay small.
    code = row[place]
    for k in range(width):
        _, code = np.unique(code * (len(words.dictionary) + 1) + words.ids[place + k], return_inverse=True)
    twice = place[np.bincount(code)[code] > 1]
    for k in range(width):
        out[twice + k] = True
    return out


def count_block(texts: pa.Array) -> dict[str, np.ndarray]:
    """The ``COUNTS`` of every text."""
    words, lines = split_words(texts), split_lines(texts)
    row, line_row = words.rows, lines.rows
    length = pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(texts)

    def share(flags: np.ndarray) -> np.ndarray:
        return row_sums(flags[words.ids].astype(np.int64), words.starts)

    filled = _flags(lines.dictionary, _WORD)[lines.ids]
    # A line is a copy unless it is the first of its text with that content.
    code = line_row * max(1, len(lines.dictionary)) + lines.ids
    first = np.zeros(len(code), bool)
    first[np.unique(code, return_index=True)[1]] = True
    own = row * max(1, len(words.dictionary)) + words.ids
    distinct, times = np.unique(own, return_counts=True)
    of = distinct // max(1, len(words.dictionary))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, of, times)
    return {
        "n_words": np.diff(words.starts), "word_chars": row_sums(length[words.ids], words.starts),
        "n_symbols": pc.count_substring_regex(texts, _SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": row_sums((filled & ~first).astype(np.int64), lines.starts),
        "n_repeat_words": row_sums(_repeated(words, row).astype(np.int64), words.starts),
        "n_lines": row_sums(filled.astype(np.int64), lines.starts),
        "n_closed_lines": row_sums((filled & _flags(lines.dictionary, _CLOSED)[lines.ids]).astype(np.int64), lines.starts),
        "n_letter_words": share(_flags(words.dictionary, _LETTER)),
        "n_number_words": share(_flags(words.dictionary, _DIGITS)),
        "n_distinct_words": np.bincount(of, minlength=n),
        "n_top_word": top,
        "n_capital_words": share(_flags(words.dictionary, r"^[A-Z]{2,}[^a-z]*$")),
    }


def count_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the ``COUNTS`` of every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                found = count_block(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)],
                    ["doc_id", *COUNTS])

    return rows.mapInArrow(run, ", ".join([f"doc_id {dict(rows.dtypes)['doc_id']}", *(f"{c} long" for c in COUNTS)]))


class Rule(NamedTuple):
    """Votes by the share ``part / whole``: good within [good_from, good_to], bad below ``bad_below`` or above
    ``bad_above``, else an abstention; without a whole it abstains."""

    name: str
    part: str
    whole: str | None
    good_from: float
    good_to: float
    bad_below: float
    bad_above: float


#: Bounds of every rule, as commonly set for web text.
RULES = (
    Rule("length", "n_words", None, 50, 100_000, 20, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 3, 10, 2.5, 14),
    Rule("symbols", "n_symbols", "n_words", 0, 0.02, -1, 0.1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0, 0.1, -1, 0.3),
    Rule("repeated_words", "n_repeat_words", "n_words", 0, 0.2, -1, 0.5),
    Rule("letters", "n_letter_words", "n_words", 0.9, 1, 0.7, 2),
    Rule("numbers", "n_number_words", "n_words", 0, 0.05, -1, 0.2),
    Rule("closed_lines", "n_closed_lines", "n_lines", 0.6, 1, 0.1, 2),
    Rule("top_word", "n_top_word", "n_words", 0, 0.15, -1, 0.3),
    Rule("capitals", "n_capital_words", "n_words", 0, 0.1, -1, 0.4),
)


def vote(rule: Rule) -> Column:
    share = F.col(rule.part).cast("double")
    if rule.whole:
        share = share / F.nullif(F.col(rule.whole).cast("double"), F.lit(0.0))
    return (F.when((share < rule.bad_below) | (share > rule.bad_above), F.lit(-1))
            .when((share >= rule.good_from) & (share <= rule.good_to), F.lit(1)).otherwise(F.lit(0)))


class Model(NamedTuple):
    """Log odds of good documents: of the prior, and of a good and a bad vote by rule."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]
    #: How often each rule is right about good and about bad documents.
    accuracy: tuple[tuple[float, float], ...]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int) -> Model:
    """Expectation-maximisation over vote patterns and their counts."""
    votes = np.asarray([p for p, _ in patterns], np.int64).reshape(-1, rules)
    n = np.asarray([c for _, c in patterns], np.float64)
    up, down = votes == 1, votes == -1
    prior = PRIOR
    # right[0] is P(vote good | good, votes), right[1] is P(vote bad | bad, votes).
    right = np.full((2, rules), START)
    while_good = np.zeros(len(n))
    for _ in range(ROUNDS):
        odds = math.log(prior / (1 - prior)) + up @ np.log(right[0] / (1 - right[1])) + down @ np.log((1 - right[0]) / right[1])
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(good - while_good).max(initial=0) < SETTLED:
            break
        while_good = good
        on_good, on_bad = n * good, n * (1 - good)
        prior = float((on_good.sum() + WEIGHT * PRIOR) / (n.sum() + WEIGHT))
        right = np.stack([(on_good @ up + WEIGHT * START) / (on_good @ (up | down) + WEIGHT),
                          (on_bad @ down + WEIGHT * START) / (on_bad @ (up | down) + WEIGHT)])
        right = np.clip(right, 0.5, 0.999)
    return Model(math.log(prior / (1 - prior)), tuple(np.log(right[0] / (1 - right[1])).tolist()),
                 tuple(np.log((1 - right[0]) / right[1]).tolist()), tuple(map(tuple, right.T.tolist())))


def learn(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """The rules' accuracies over every row of ``counted``; the driver gets at most 3 ** len(rules) rows."""
    names = [f"v{i}" for i in range(len(rules))]
    found = counted.select(*[vote(r).alias(v) for r, v in zip(rules, names)]).groupBy(*names).count().collect()
    return estimate(sorted((tuple(r)[:-1], r[-1]) for r in found), len(rules))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the posterior probability ``quality`` of every row."""
    counted = materialise(count_documents(docs, key, text), "weakrules")
    model = learn(counted, rules)
    odds = F.lit(model.prior)
    for rule, good, bad in zip(rules, model.good, model.bad):
        v = vote(rule)
        odds = odds + F.when(v == 1, F.lit(good)).when(v == -1, F.lit(bad)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    judged = counted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.col("quality") >= KEEP)).alias("kept"), "quality")
