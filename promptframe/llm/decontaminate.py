"""Operator 3: benchmark decontamination by latent semantic retrieval.

The benchmark's passages are TF-IDF vectors over ``TERMS`` hashed terms; the
document frequencies come from all documents.  Every ``INDEX_BLOCK`` passages have a
latent space of their own by a randomised SVD (Halko, Martinsson, Tropp): its rank is
doubled from ``RANK`` on until every passage of the block keeps ``ENERGY`` of its squared
norm.  Every document is searched in windows of ``WINDOW`` words, half a window apart: a
window is folded into the latent space and normalised there, as the passages are, and
passages with a cosine of ``COSINE`` or more are candidates.  A candidate counts if the longest
common subsequence of words, in the window's surroundings, holds ``COVER`` of
the passage, and if enough of its answer is there in order (``ANSWER``;
without an answer column the passage's last sentence), so paraphrases that keep most
words are found and texts on the same matter are not.

What is broadcast is bounded: ``SCAN_BLOCKS`` latent spaces of ``INDEX_BLOCK`` passages,
over the terms that occur in them; a larger benchmark takes more scans.

Defined results: null or empty texts and passages match nothing; repeated rows
are judged each; a null id stays null; empty tables give empty results; other columns ride along in
:func:`remove_leaks`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptframe.session import ship_package

from .align import lcs
from .blocks import text_blocks, words
from .common import materialise, numbered, quoted, with_rows

TERMS = 1 << 15
RANK, OVERSAMPLE = 128, 8
WINDOW = 32
PASSAGE = 64
COSINE = 0.35
COVER, ANSWER = 0.65, 0.5
#: Share of every passage's squared norm that its latent space keeps, at least.
ENERGY = 0.95
#: Passages of one latent space, and latent spaces of one scan.
INDEX_BLOCK, SCAN_BLOCKS = 256, 8
#: Candidates checked at a time, and half windows summed at a time.
CHECK = 4096
SUMMED = 1024


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(17)).astype(np.int64) & (TERMS - 1)


def _frequencies(batches):
    total = np.zeros(TERMS, np.int64)
    rows = 0
    for batch in batches:
        for _, flat, starts in text_blocks(batch.column(0)):
            _, _, h, at = words(flat, starts)
            doc = np.repeat(np.arange(len(starts) - 1), np.diff(at))
            once = np.unique(doc * TERMS + _slots(h))
            total += np.bincount(once % TERMS, minlength=TERMS)
            rows += len(starts) - 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"slot": pa.array(np.append(at, -1)), "n": pa.array(np.append(total[at], rows))})


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Inverse document frequency by slot, over all documents (at most TERMS + 1 rows reach the driver)."""
    rows = (docs.select(F.col(quoted(text_col))).mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect())
    counts, total = np.zeros(TERMS), 0
    for slot, n in rows:
        if slot < 0:
            total = n
        else:
            counts[slot] = n
    return np.log((total + 1.0) / (counts + 1.0))


def _answer_words(text: str) -> int:
    """Words of the last sentence."""
    body = text.rstrip()
    cut = max(body[:-1].rfind(". "), body[:-1].rfind(".\n"), body[:-1].rfind("? "))
    return len(body[cut + 1:].split())


def _passages(batches):
    """Passages of at most PASSAGE words: (item, words as hashes, how many last ones are the answer)."""
    for batch in batches:
        item, kept, answer = [], [], []
        ids, texts, answers = (batch.column(i) for i in range(3))
        for row, flat, starts in text_blocks(texts):
            _, _, h, at = words(flat, starts)
            for i in range(len(starts) - 1):
                own = h[at[i]:at[i + 1]]
                if not len(own):
                    continue
                given = answers[row + i].as_py()
                tail = len(given.split()) if given else _answer_words(texts[row + i].as_py())
                n = -(-len(own) // PASSAGE)
                for k, part in enumerate(np.array_split(own, n)):
                    item.append(ids[row + i].as_py())
                    kept.append(part.tobytes())
                    answer.append(min(tail, len(part)) if k == n - 1 else 0)
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(item, pa.int64()), "words": pa.array(kept, pa.binary()),
                                          "answer": pa.array(answer, pa.int64())})


def _weights(raw: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot, n = np.unique(_slots(np.frombuffer(raw, np.uint64)), return_counts=True)
    w = n * idf[slot]
    return slot, w / max(np.sqrt((w * w).sum()), 1e-12)


def fit_projection(weights: list, rank: int = RANK, energy: float = ENERGY, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The slots that occur in the passages, and the top right singular vectors over them (slots x rank).

    ``weights`` are the rows of one block as pairs (slots, values); the rank grows until every row keeps ``energy``.
    """
    slots = np.unique(np.concatenate([slot for slot, _ in weights]))
    matrix = np.zeros((len(weights), len(slots)))
    for row, (slot, w) in zip(matrix, weights):
        row[np.searchsorted(slots, slot)] = w
    norms = (matrix * matrix).sum(axis=1)
    random = np.random.Generator(np.random.PCG64(seed))
    while True:
        width = min(rank + OVERSAMPLE, len(slots))
        q, _ = np.linalg.qr(matrix.T @ (matrix @ random.standard_normal((len(slots), width))))
        c = matrix @ q
        values, vectors = np.linalg.eigh(c.T @ c)
        order = np.argsort(-values)[:rank]
        top = vectors[:, order[values[order] > 1e-9]]
        kept = c @ top
        if rank >= min(matrix.shape) or ((kept * kept).sum(axis=1) >= energy * norms).all():
            return slots, q @ top
        rank *= 2


def _space(rows: list, idf: np.ndarray, rank: int, energy: float) -> tuple:
    """One block of passages as the search needs it; its words are numbered from 1, 0 is any other word."""
    weights = [_weights(r["words"], idf) for r in rows]
    slots, folded = fit_projection(weights, rank, energy)
    at = np.full(TERMS, -1, np.int32)
    at[slots] = np.arange(len(slots), dtype=np.int32)
    index = np.stack([w @ folded[at[slot]] for slot, w in weights])
    index /= np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)
    tokens = [np.frombuffer(r["words"], np.uint64) for r in rows]
    vocabulary = np.unique(np.concatenate(tokens))
    has = np.zeros((len(rows), len(vocabulary) + 1), bool)
    for i, t in enumerate(tokens):
        has[i, np.searchsorted(vocabulary, t) + 1] = True
    return (at, (folded * idf[slots][:, None]).astype(np.float32), index.astype(np.float32), vocabulary, has,
            [r["item_id"] for r in rows], tokens, [r["answer"] for r in rows])


def _pairs(rows: list) -> np.ndarray:
    while len(rows) > 1:
        rows = [a + b for a, b in zip(rows[::2], rows[1::2])]
    return rows[0]


def _folded_windows(slot: np.ndarray, at: np.ndarray, folded: np.ndarray, begin: np.ndarray, joined: np.ndarray):
    """The windows in the latent space, of length one; a window without a known word is zero."""
    sums = np.zeros((len(begin), folded.shape[1]), np.float32)
    known = at[slot]
    use = np.flatnonzero(known >= 0)
    if len(use):
        # Sums over half windows of the folded rows of known words; a window is two of them.
        part = np.searchsorted(begin, use, "right") - 1
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        count = np.diff(np.append(edge, len(use)))
        # Longest first, so that the parts with a next word are the first ones: one sum of rows for each place in a part.
        order = np.argsort(-count, kind="stable")
        for lo in range(0, len(order), SUMMED):
            some = order[lo:lo + SUMMED]
            total = folded[known[use[edge[some]]]]
            # In the order of numpy's own sums: eight and more words after the first begin in pairs.
            eight, rest = np.searchsorted(-count[some], -8), np.zeros_like(total)
            rest[:eight] = _pairs([folded[known[use[edge[some[:eight]] + i]]] for i in range(1, 9)])
            for place in range(1, count[some[0]]):
                longer = np.searchsorted(-count[some], -place)
                first = eight if place < 9 else 0
                rest[first:longer] += folded[known[use[edge[some[first:longer]] + place]]]
            total += rest
            sums[part[edge[some]]] = total
        sums[:-1] += np.where(joined[:-1, None], sums[1:], 0)
    norm = np.sqrt(np.einsum("ij,ij->i", sums, sums))
    return sums / np.maximum(norm, 1e-9)[:, None]


def _search(shared, cosine: float, cover: float, answer: float):
    half = WINDOW // 2

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for row, flat, starts in text_blocks(batch.column(1)):
                _, _, h, at = words(flat, starts)
                if not len(h):
                    continue
                slot = _slots(h)
                size = np.diff(at)
                steps = -(-size // half)
                begin = np.concatenate([at[i] + half * np.arange(n) for i, n in enumerate(steps)]).astype(np.int64)
                doc = np.repeat(np.arange(len(size)), steps)
                joined = np.concatenate([doc[1:] == doc[:-1], [False]])
                for slots, folded, index, vocabulary, has, items, tokens, tails in shared.value:
                    near = _folded_windows(slot, slots, folded, begin, joined) @ index.T
                    w, p = np.nonzero(near >= cosine)
                    length = np.asarray([len(t) for t in tokens])
                    low = np.maximum(at[doc[w]], begin[w] - length[p])
                    high = np.minimum(at[doc[w] + 1], begin[w] + WINDOW + length[p])
                    number = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    number = np.where(vocabulary[number] == h, number + 1, 0)
                    # No subsequence is longer than the words of the surroundings that the passage has at all.
                    enough = np.zeros(len(w), bool)
                    span = np.arange(WINDOW + 2 * PASSAGE)
                    for k in range(0, len(w), CHECK):
                        c = slice(k, k + CHECK)
                        place = low[c, None] + span
                        inside = place < high[c, None]
                        there = np.where(inside, number[np.minimum(place, len(h) - 1)], 0)
                        enough[c] = has[p[c, None], there].sum(axis=1) >= cover * length[p[c]] - 1e-9
                    for k in np.flatnonzero(enough).tolist():
                        i, j = int(w[k]), int(p[k])
                        want, there = tokens[j], h[low[k]:high[k]]
                        share = lcs(want, there) / len(want)
                        if share < cover:
                            continue
                        tail = tails[j]
                        if tail and lcs(want[len(want) - tail:], there) < answer * tail:
                            continue
                        out.append((row + int(doc[i]), items[j], float(near[i, j]), share))
            rows = np.asarray([r[0] for r in out], np.int64)
            yield pa.RecordBatch.from_pydict({
                "rid": batch.column(0).take(pa.array(rows)), "item_id": pa.array([r[1] for r in out], pa.int64()),
                "cosine": pa.array([r[2] for r in out], pa.float64()),
                "lcs_share": pa.array([r[3] for r in out], pa.float64())})
    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               bench_text: str = "text", answer_col: str | None = None, rank: int = RANK, cosine: float = COSINE,
               cover: float = COVER, answer: float = ANSWER, energy: float = ENERGY) -> DataFrame:
    """Per document and benchmark item found in it: rid (the row's number), item_id, cosine, lcs_share.

    ``docs`` must be a table read from Parquet files (see :func:`numbered`).
    """
    spark = docs.sparkSession
    ship_package(spark)
    given = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    passages = materialise(
        benchmark.select(F.col(item_col).cast("long"), F.col(bench_text), given.alias("answer"))
        .mapInArrow(_passages, "item_id long, words binary, answer long"), "bench-passages")
    rows = numbered(docs, "rid", text=F.col(quoted(text_col)))
    schema = "rid long, item_id long, cosine double, lcs_share double"
    idf = document_frequencies(docs, text_col)
    found = spark.createDataFrame([], schema)
    own = passages.sort("item_id", "words", "answer").toLocalIterator()
    # The spaces of one scan are bounded by SCAN_BLOCKS * INDEX_BLOCK passages of at most PASSAGE words.
    while spaces := [_space(b, idf, rank, energy)
                     for _ in range(SCAN_BLOCKS) if (b := list(itertools.islice(own, INDEX_BLOCK)))]:
        found = found.union(rows.mapInArrow(_search(spark.sparkContext.broadcast(spaces), cosine, cover, answer), schema))
    return found.groupBy("rid", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"))


def leaked_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """find_leaks with the documents' ids: doc_id, item_id, cosine, lcs_share."""
    ids = numbered(docs, "rid", doc_id=F.col(quoted(id_col)).cast("long"))
    return find_leaks(docs, benchmark, **options).join(ids, "rid").drop("rid")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, with all their columns."""
    return with_rows(docs, find_leaks(docs, benchmark, **options).select("rid").distinct(), "rid", "left_anti")
