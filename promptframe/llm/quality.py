"""Operator 7: quality (and toxicity) classifiers by co-training.

Two views of a page: its text (presence of hashed words) and its metadata
(source, language, and the layout: length, lines, shares of letters, capitals, digits and
marks).  Each view has a logistic classifier.  Over ``ROUNDS`` rounds both classifiers
score all unlabelled pages, and of the pages one is confident of (``CONFIDENT``), the ``PER_ROUND`` surest,
which are ranked over all of them, become pseudo-labels for the other view.  Both are then calibrated on labelled
pages kept out of training, and a logistic combination of the two, fitted there too, scores all documents.

The classifiers are fitted on at most ``TRAIN_ROWS`` labelled rows, chosen by hash, and ``PER_ROUND``
pseudo-labels a view and round.  Every document is scored over its whole text.  An id that several rows bear
counts once in training, by the row with the smallest hash of its content.

Defined results: a null text is empty and is scored by its metadata; null metadata is
a value of its own; a target with one label only gives the share of that label;
repeated rows are scored alike; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptframe.session import ship_package

from .blocks import text_blocks, words

SLOTS = 1 << 16
TRAIN_ROWS = 12_000
ROUNDS, CONFIDENT, PER_ROUND = 3, 0.95, 400
NAMES, LAYOUT = 64, 10
META = 2 * NAMES + LAYOUT
TARGETS = ("quality", "toxic")

Sparse = tuple[np.ndarray, np.ndarray]


def _slots(h: np.ndarray) -> np.ndarray:
    return np.unique((h >> np.uint64(23)).astype(np.int64) & (SLOTS - 1))


#: ASCII marks count as white space between words.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 0x20


def page_views(texts: pa.Array, sources: list, langs: list):
    """Yield (word slots, metadata vector) of each page."""
    for row, flat, starts in text_blocks(texts):
        _, _, h, at = words(_PLAIN[flat], starts)
        for i in range(len(starts) - 1):
            raw = flat[starts[i]:starts[i + 1]]
            n = max(len(raw), 1)
            letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
            upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
            space = (raw == 32) | (raw == 10)
            lines = int((raw == 10).sum()) + 1
            count = int(at[i + 1] - at[i])
            marks = 1.0 - (letter.sum() + digit.sum() + space.sum()) / n
            meta = np.zeros(META)
            meta[zlib.crc32(f"s{sources[row + i]}".encode()) % NAMES] = 1
            meta[NAMES + zlib.crc32(f"l{langs[row + i]}".encode()) % NAMES] = 1
            meta[2 * NAMES:] = (np.log1p(len(raw)) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 5,
                                letter.sum() / n, 3 * upper.sum() / n, 5 * digit.sum() / n, 5 * marks,
                                count / n * 5, 20 * (raw == 33).sum() / n, len(np.unique(h[at[i]:at[i + 1]])) / max(count, 1))
            yield _slots(h[at[i]:at[i + 1]]), meta


class Logistic:
    """Logistic regression on index lists or dense rows: adaptive full-batch steps with an L1 penalty."""

    def __init__(self, size: int, penalty: float, steps: int = 80, rate: float = 0.2):
        self.w, self.b, self.penalty, self.steps, self.rate = np.zeros(size), 0.0, penalty, steps, rate

    def margin(self, x) -> np.ndarray:
        if isinstance(x, np.ndarray):
            return x @ self.w + self.b
        lens = np.fromiter(map(len, x), np.int64, len(x))
        sums = np.concatenate([[0.0], np.cumsum(self.w[np.concatenate(x)])]) if lens.sum() else np.zeros(1)
        ends = np.cumsum(lens)
        return sums[ends] - sums[ends - lens] + self.b

    def fit(self, x, y: np.ndarray) -> "Logistic":
        weight = np.where(y > 0.5, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) / len(y)
        dense = isinstance(x, np.ndarray)
        if not dense:
            at, row = np.concatenate(x), np.repeat(np.arange(len(x)), [len(v) for v in x])
        past, past_b = np.full(len(self.w), 1e-8), 1e-8
        for _ in range(self.steps):
            error = (1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30))) - y) * weight
            g = x.T @ error if dense else np.bincount(at, error[row], len(self.w))
            past, past_b = past + g * g, past_b + error.sum() ** 2
            pace = self.rate / np.sqrt(past)
            w = self.w - pace * g
            self.w = np.sign(w) * np.maximum(np.abs(w) - pace * self.penalty, 0)
            self.b -= self.rate * error.sum() / np.sqrt(past_b)
        return self


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a calibrating logistic curve."""
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (w[:, None] * x) + 1e-2 * np.eye(2), x.T @ (target - p))
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class CoTrained:
    """Both views of one target, calibrated and combined."""

    def __init__(self, content: list, meta: np.ndarray, y: np.ndarray, held: np.ndarray):
        self.constant = float(y.mean()) if len(np.unique(y[~held])) < 2 else None
        if self.constant is not None:
            return
        own = np.flatnonzero(~held)
        self.labels, self.taken = [y[own].copy(), y[own].copy()], [set(), set()]
        self.data = [[content[i] for i in own], meta[own]]
        at = np.flatnonzero(held)
        self.kept_out = ([content[i] for i in at], meta[at]), y[at]
        self.views = [Logistic(SLOTS, 2e-3), Logistic(META, 1e-4)]
        self.learn()

    def learn(self) -> None:
        """Fit both views to the labels they have, and their curves to the pages kept out."""
        for view, rows, given in zip(self.views, self.data, self.labels):
            view.fit(rows, given)
            view.steps = 30  # later rounds go on from the weights there are
        (both, y), self.curves = self.kept_out, [(1.0, 0.0), (1.0, 0.0)]
        if len(np.unique(y)) == 2:
            self.curves = [_platt(v.margin(b), y) for v, b in zip(self.views, both)]

    def take(self, view: int, pages: list) -> None:
        """Pseudo-labels (page, slots, meta, label) for a view."""
        self.taken[view].update(p[0] for p in pages)
        if pages:
            self.labels[view] = np.concatenate([self.labels[view], [p[3] for p in pages]])
            new = [np.asarray(p[1], np.int64) for p in pages] if view == 0 else np.asarray([p[2] for p in pages])
            self.data[view] = self.data[view] + new if view == 0 else np.concatenate([self.data[view], new])

    def finish(self) -> None:
        """The mix of the two views; what was learned from is let go, so that the model is small."""
        if self.constant is not None:
            return
        both, y = self.kept_out
        self.mix = (0.5, 0.5, 0.0)
        if len(np.unique(y)) == 2:
            z = np.stack([_logit(self._one(0, both[0])), _logit(self._one(1, both[1]))], 1)
            m = Logistic(2, 1e-5, 300).fit(z, y)
            self.mix = (max(m.w[0], 0.0), max(m.w[1], 0.0), float(m.b))
        del self.labels, self.data, self.kept_out

    def _one(self, view: int, x) -> np.ndarray:
        a, b = self.curves[view]
        return 1 / (1 + np.exp(-np.clip(a * self.views[view].margin(x) + b, -30, 30)))

    def scores(self, content: list, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Content view, metadata view, combination."""
        if self.constant is not None:
            return (np.full(len(content), self.constant),) * 3
        a, b = self._one(0, content), self._one(1, meta)
        z = self.mix[0] * _logit(a) + self.mix[1] * _logit(b) + self.mix[2]
        return a, b, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _views(rows: DataFrame) -> list:
    """Views and labels of a bounded table of rows, in order of their hash."""
    def run(batches):
        for batch in batches:
            c = batch.select(["source", "lang"]).to_pydict()
            views = list(page_views(batch.column(0), c["source"], c["lang"]))
            yield pa.RecordBatch.from_pydict({
                "h": batch.column(3), "slots": pa.array([v[0] for v in views], pa.list_(pa.int64())),
                "meta": pa.array([v[1] for v in views], pa.list_(pa.float64())), "quality": batch.column(4),
                "toxic": batch.column(5)})

    schema = "h long, slots array<long>, meta array<double>, quality double, toxic double"
    found = rows.select("text", "source", "lang", "h", *TARGETS).mapInArrow(run, schema).collect()
    return sorted(found, key=lambda r: r["h"])


def _surest(rows: DataFrame, known: DataFrame, models: dict[str, CoTrained]) -> list:
    """Of every target and giving view, among rows without a label (``known`` has the labelled ``h``), the ``PER_ROUND`` unlabelled pages it is surest of, with their views."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(
        {t: (m.views, m.curves, [np.fromiter(m.taken[1 - g], np.int64) for g in (0, 1)]) for t, m in models.items()})

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                c = part.select(["source", "lang"]).to_pydict()
                views = list(page_views(part.column(0), c["source"], c["lang"]))
                x = [v[0] for v in views], np.asarray([v[1] for v in views])
                h = part.column(3).to_numpy()
                found: list[tuple] = []
                for t, (own, curves, taken) in shared.value.items():
                    for giver in (0, 1):
                        a, b = curves[giver]
                        p = 1 / (1 + np.exp(-np.clip(a * own[giver].margin(x[giver]) + b, -30, 30)))
                        sure = np.maximum(p, 1 - p)
                        found += [(t, giver, float(p[i]), float(sure[i]), int(h[i]))
                                  for i in np.flatnonzero((sure >= CONFIDENT) & ~np.isin(h, taken[giver]))]
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_pydict({n: pa.array(list(v), k) for n, v, k in zip(
                    ("target", "giver", "p", "sure", "h"), cols,
                    (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.int64()))})

    best = Window.partitionBy("target", "giver").orderBy(F.desc("sure"), "h", "p")
    # Labelled pages go after scoring, so that no text is shuffled; an id of many rows counts once.
    scored = (rows.select("text", "source", "lang", "h")
              .mapInArrow(run, "target string, giver long, p double, sure double, h long")
              .groupBy("target", "giver", "h").agg(F.max(F.struct("sure", "p")).alias("s"))
              .join(known.select("h"), "h", "left_anti").select("target", "giver", "h", "s.*"))
    # The rank's limit goes before the shuffle, so a task sends at most PER_ROUND rows a target and view.
    top = scored.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= PER_ROUND).collect()
    shared.destroy()
    if not top:
        return []
    picked = spark.createDataFrame([(h,) for h in sorted({r["h"] for r in top})], "h long")  # at most 4 * PER_ROUND
    chosen = rows.join(F.broadcast(picked), "h").select("*", *[F.lit(0.0).alias(t) for t in TARGETS])
    views = {r["h"]: r for r in _views(_one_each(chosen, "h"))}
    return [(r["target"], r["giver"], (r["h"], views[r["h"]]["slots"], views[r["h"]]["meta"], float(r["p"] > 0.5)))
            for r in sorted(top, key=lambda r: (r["target"], r["giver"], r["__rank"])) if r["h"] in views]


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of every ``key``: the one with the smallest hash of its content."""
    content = F.struct(F.xxhash64("text", "source", "lang").alias("c"), "text", "source", "lang", "h", *TARGETS)
    return rows.groupBy(key).agg(F.min(content).alias("r")).select("r.*")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        lang_col: str = "lang") -> dict[str, CoTrained | None]:
    """One co-trained classifier per target."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"),
                       F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        *[F.max(F.col(t).cast("double")).alias(t) for t in TARGETS]).where("quality is not null and toxic is not null")
    ids = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    train = _views(_one_each(rows.join(F.broadcast(ids), "id"), "id"))  # at most TRAIN_ROWS ids
    if not train:
        return {t: None for t in TARGETS}
    content, meta = [np.asarray(r["slots"], np.int64) for r in train], np.asarray([r["meta"] for r in train])
    held = np.asarray([r["h"] % 4 == 0 for r in train], bool)
    models = {t: CoTrained(content, meta, np.asarray([r[t] for r in train]), held) for t in TARGETS}
    learners = {t: m for t, m in models.items() if m.constant is None}
    rows, known = rows.where("id is not null"), known.select(F.xxhash64("id").alias("h"))
    for _ in range(ROUNDS if learners else 0):
        found = _surest(rows, known, learners)
        if not found:
            break
        for t, m in learners.items():
            for giver in (0, 1):
                m.take(1 - giver, [page for target, g, page in found if (target, g) == (t, giver)])
            m.learn()
    for m in models.values():
        m.finish()
    return models


def score_documents(docs: DataFrame, models: dict[str, CoTrained], id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, content_score, metadata_score, score (quality), toxic_score, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                c = part.select(["source", "lang"]).to_pydict()
                views = list(page_views(part.column(1), c["source"], c["lang"]))
                content, meta = [v[0] for v in views], np.asarray([v[1] for v in views])
                if shared.value["quality"] is None:  # no labels
                    q = (np.full(len(views), 0.5),) * 3
                    tox = np.zeros(len(views))
                else:
                    q = shared.value["quality"].scores(content, meta)
                    tox = shared.value["toxic"].scores(content, meta)[2]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "content_score": pa.array(q[0]), "metadata_score": pa.array(q[1]),
                    "score": pa.array(q[2]), "toxic_score": pa.array(tox), "kept": pa.array((q[2] >= 0.5) & (tox < 0.5))})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), F.col(source_col).alias("source"),
                       F.col(lang_col).alias("lang"))
    return rows.mapInArrow(run, "doc_id long, content_score double, metadata_score double, score double, "
                                "toxic_score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    return score_documents(docs, fit(docs, labels, **columns), **columns)
