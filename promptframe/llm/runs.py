"""Operator 13: periodic runs in the words of a text, found by multi-scale minimizers.

A run is a stretch of words with smallest period ``q`` and at least ``max(MIN_LENGTH, MIN_EXPONENT * q)``
words that cannot be extended on either side with that period.

* Periods up to ``DIRECT`` words are found by comparing the words with themselves at every such lag.
* For a scale ``L`` (32, 64, 128, ...) and the periods ``q`` in (L/2, L], the ``L``-grams of the text are
  hashed by doubling, and every window of L/2 + 1 places keeps its least gram.  A run of that
  period is at least 4q words long and repeats its grams q apart, so some window and the one q places on lie
  in it together and keep grams q apart; as a gram is at least as long as the period and the period is the
  smallest, the gram does not occur between them.  So consecutive places of one kept gram, L/2 < d <= L
  apart, include a seed of every run of the scale.
* A seed is extended on both sides by comparing word numbers, which is exact; seeds of the same lag within
  a stretch already extended are passed over, and stretches whose smallest period is a proper
  divisor of the lag are dropped (that period's own scale finds them).

The hash orders the minima and proposes places; what is a run is decided on the words themselves.

Defined results: a null text has no words; without a run the four columns of the greatest run are null and the
hash of the runs is that of nothing; a null key's text is taken as it is; rows are independent, so
repeated rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptframe.session import ship_package

from .blocks import mix, sliding_min
from .wordblocks import Words, joined, split_words, text_slices

MIN_LENGTH, MIN_EXPONENT = 6, 4
DIRECT = 16


def _is_smallest(w: np.ndarray, start: int, lag: int) -> bool:
    """Whether ``lag`` is the smallest period of a stretch that starts at ``start`` and repeats at least 4 times."""
    rest, primes, p = lag, [], 2
    while p * p <= rest:
        if rest % p == 0:
            primes.append(p)
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        primes.append(rest)
    for p in primes:
        d = lag // p
        if np.array_equal(w[start:start + lag], w[start + d:start + d + lag]):
            return False
    return True


def _grow(w: np.ndarray, low: int, high: int, at: int, lag: int) -> tuple[int, int]:
    """The widest stretch around ``at`` within [low, high) in which words ``lag`` apart are equal."""
    end, step = at, 64  # end: first place whose word differs from the one lag after it
    while end + lag < high:
        stop = min(end + step, high - lag)
        differ = np.flatnonzero(w[end:stop] != w[end + lag:stop + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, 2 * step
    start, step = at, 64
    while start > low:
        stop = max(low, start - step)
        differ = np.flatnonzero(w[stop:start] != w[stop + lag:start + lag])
        if len(differ):
            start = stop + int(differ[-1]) + 1
            break
        start, step = stop, 2 * step
    return start, end + lag


def _short(w: np.ndarray, row: np.ndarray, found: list) -> None:
    """Runs with a period of at most ``DIRECT`` words."""
    for lag in range(1, min(DIRECT, len(w) - 1) + 1):
        same = (w[:-lag] == w[lag:]) & (row[:-lag] == row[lag:])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        # Each row ends with places that have no word one lag on, so no stretch crosses a row's border.
        starts, ends = edges[::2], edges[1::2] + lag
        long = ends - starts >= max(MIN_LENGTH, MIN_EXPONENT * lag)
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            if _is_smallest(w, s, lag):
                found.append((s, e - s, lag))


def _scaled(w: np.ndarray, rows: np.ndarray, starts: np.ndarray, codes: np.ndarray, found: list) -> None:
    """Runs with longer periods, scale by scale, until no row is long enough."""
    sizes, place = np.diff(starts), np.arange(len(w), dtype=np.uint64)
    low_bits = np.uint64((1 << len(w).bit_length()) - 1)
    ends = starts[1:][rows]
    gram, size = codes, 1
    while size < DIRECT:
        gram, size = _double(gram, size), 2 * size
    while sizes.max(initial=0) >= MIN_EXPONENT * (size + 1):
        shortest = size  # periods of this scale are longer
        gram, size = _double(gram, size), 2 * size
        width = shortest + 1
        # Least gram of every window, the leftmost of equal ones: a place stands in the hash's low bits.
        least = sliding_min((gram & ~low_bits) | place, width)
        whole = np.arange(len(least)) + (width - 1 + size) <= ends[:len(least)]
        kept = np.unique(least[whole] & low_bits).astype(np.int64)
        kept = kept[np.lexsort((kept, gram[kept], rows[kept]))]
        lag = np.diff(kept)
        here, there = kept[:-1], kept[1:]
        seed = (rows[here] == rows[there]) & (gram[here] == gram[there]) & (lag > shortest) & (lag <= size)
        at, lag = here[seed], lag[seed]
        order = np.lexsort((at, lag, rows[at]))
        _extend(w, rows, starts, at[order], lag[order], found)


def _extend(w: np.ndarray, rows: np.ndarray, starts: np.ndarray, at: np.ndarray, lag: np.ndarray, found: list) -> None:
    """Extend seeds in order of (row, lag, place), one for each stretch."""
    group = np.flatnonzero(np.concatenate([[True], (np.diff(rows[at]) != 0) | (np.diff(lag) != 0), [True]])) if len(at) else []
    for first, last in zip(group[:-1], group[1:]):
        d, r, i = int(lag[first]), int(rows[at[first]]), int(first)
        while i < last:
            s, e = _grow(w, int(starts[r]), int(starts[r + 1]), int(at[i]), d)
            if e - s >= MIN_EXPONENT * d and _is_smallest(w, s, d):
                found.append((s, e - s, d))
            # Later seeds that begin within this stretch belong to it.
            i += max(1, int(np.searchsorted(at[i:last], e - d, "left")))


def _double(gram: np.ndarray, size: int) -> np.ndarray:
    """Hashes of grams twice as long; those that would leave the block or their row are never used."""
    out = gram.copy()
    if len(gram) > size:
        out[:-size] = mix(gram[:-size] * np.uint64(0x9E3779B97F4A7C15) + mix(gram[size:]))
    return out


def find_runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run, starts counted in the block, by start and then period."""
    found: list[tuple[int, int, int]] = []
    w = words.ids
    if len(w):
        rows = words.rows
        _short(w, rows, found)
        codes = mix((np.arange(len(words.dictionary), dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
        _scaled(w, rows, words.starts, codes[w], found)
    runs = np.asarray(sorted({(s, p, n) for s, n, p in found}), np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 2], runs[:, 1]


def unrolled(words: Words, keys: list) -> Words:
    """The words with the stated rows made periodic: see the query's contract."""
    ids = words.ids.copy()
    for r, key in enumerate(keys):
        low, n = int(words.starts[r]), int(words.starts[r + 1] - words.starts[r])
        if key is None or not n:
            continue
        g, last = divmod(zlib.crc32(str(key).encode()), 10)
        if last == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ids[low + a:low + n] = words.ids[low + a + np.arange(n - a) % p]
    return words._replace(ids=ids)


def _digest(values) -> pa.Array:
    return pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())


def describe(words: Words) -> dict[str, pa.Array]:
    """The result columns of every row of a block."""
    start, length, period = find_runs(words)
    n = len(words.starts) - 1
    of = np.searchsorted(words.starts, start, "right") - 1
    first = start - words.starts[of]
    listed: list[list[str]] = [[] for _ in range(n)]
    for r, s, k, q in zip(of.tolist(), first.tolist(), length.tolist(), period.tolist()):
        listed[r].append(f"{s},{k},{q}\n")
    best = np.full(n, -1)
    order = np.lexsort((period, first, -length, of))
    best[of[order][::-1]] = order[::-1]
    none = best < 0
    # Words after a run's first period: +1 where such a stretch begins, -1 where it ends.
    step = np.zeros(len(words.ids) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    kept = np.cumsum(step)[:-1] == 0
    pick = np.where(none, 0, best)
    if not len(start):
        start = first = length = period = np.zeros(1, np.int64)

    def column(values: np.ndarray) -> pa.Array:
        return pa.array(values[pick], pa.int64(), mask=none)

    text = joined(words, kept)
    return {"n_runs": pa.array(np.bincount(of, minlength=n)), "start": column(first), "length": column(length),
            "period": column(period), "exponent_milli": column(1000 * length // np.maximum(period, 1)),
            "runs_sha256": _digest("".join(x).encode() for x in listed),
            "collapsed_sha256": _digest(t.as_buffer() for t in text)}


COLUMNS = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", planted: bool = False) -> DataFrame:
    """The runs of every row; ``planted`` first makes the rows chosen by their key's hash periodic (test material)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch in batches:
            for first, texts in text_slices(batch.column(1), 1 << 20):
                words, ids = split_words(texts), batch.column(0).slice(first, len(texts))
                found = describe(unrolled(words, ids.to_pylist()) if planted else words)
                yield pa.RecordBatch.from_arrays([ids, *found.values()], ["doc_id", *found])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {COLUMNS}")
