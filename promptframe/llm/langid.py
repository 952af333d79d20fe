"""Operator 4: language identification by rank-order n-gram profiles.

A text's letters (lower-cased, words parted by one space) give n-grams of one to three
characters that don't cross a word's edge.  A language's profile is the
``PROFILE`` most frequent n-grams of its labelled texts, in order; a text's
own n-grams are ranked the same way, and the distance to a language is the sum
of how far each is out of its place there (``PROFILE`` for one it lacks).  The
nearest language wins; ties go to the name that sorts first.

Defined results: a null text or one without a letter is ``und`` with score 0;
a row with a null id is predicted, not held out and not learned from; if nothing could be
learned every text is ``und``; repeated rows count as often as they occur;
empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptframe.session import ship_package

UNKNOWN = "und"
PROFILE = 300
HELD_OUT_OF, HELD_OUT = 4, 2
_SPACE = 0x20
_BITS = np.uint64(21)
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (n and up to three code points in 64 bits) and their counts."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cp = np.concatenate([[_SPACE], np.where(letter, cp, _SPACE), [_SPACE]]).astype(np.uint64)
    space = cp == _SPACE
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    cp, space = cp[keep], space[keep]
    one = cp[~space] | np.uint64(1 << 62)
    two = (cp[:-1] << _BITS) | cp[1:]
    three = (two[:-1] << _BITS) | cp[2:] | np.uint64(3 << 62)
    return np.unique(np.concatenate([one, two | np.uint64(2 << 62), three[~space[1:-1]]]), return_counts=True)


def ranked(found: tuple[np.ndarray, np.ndarray], size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order of rank; equal counts in order of the n-gram."""
    keys, counts = found
    return keys[np.lexsort((keys, -counts))[:size]]


def _held_out(id_col: str):
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % HELD_OUT_OF == HELD_OUT, F.lit(False))


def _count_grams(batches):
    for batch in batches:
        by_lang: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_lang.setdefault(lang, []).append(grams(text))
        for lang, found in by_lang.items():
            keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()),
                                              "gram": pa.array(keys.view(np.int64)), "n": pa.array(counts)})


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of the labelled rows of ``docs``: counts over all of them."""
    ship_package(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = (labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
              .mapInArrow(_count_grams, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # Order of the unsigned n-gram codes, as in ranked().
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    # The filter is on the row number itself, so each task forwards a language's first ``size`` n-grams only.
    first = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    return first.select("lang", "gram", (F.col("place") - 1).alias("rank"))


class Profiles:
    """All profiles as one table: sorted n-grams and each one's rank by language (``size`` if it lacks it)."""

    def __init__(self, rows, size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.keys = np.unique(np.asarray([r[1] for r in rows], np.int64).view(np.uint64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        at = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.keys, np.asarray(gram, np.int64).view(np.uint64)), at[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(grams(text), self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        i = np.searchsorted(self.keys, own)
        i[i < len(self.keys)] = np.where(self.keys[i[i < len(self.keys)]] == own[i < len(self.keys)],
                                         i[i < len(self.keys)], len(self.keys))
        there = self.ranks[i]
        out = np.where(there < 0, self.size, np.abs(there - np.arange(len(own))[:, None]))
        total = out.sum(axis=0)
        best = int(np.argmin(total))
        return self.langs[best], float(1.0 - total[best] / (self.size * len(own)))


def predict_languages(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; only ``text_col`` is read for them."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            names = [*batch.schema.names, "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()),
                                              pa.array([s for _, s in found], pa.float64())], names)

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the rows that are not held out; the driver gets ``PROFILE`` rows a language."""
    learned = docs.where(F.col(id_col).isNotNull() & ~_held_out(id_col))
    return Profiles([tuple(r) for r in learn_profiles(learned, text_col, lang_col).collect()])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict_languages(rows, fit(docs, id_col, text_col, lang_col)).drop("text")
