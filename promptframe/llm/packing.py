"""Operator 1: packing by length patterns and non-negative least squares.

The lengths of all pieces form a histogram of at most ``cap`` numbers, however
many documents there are.  On it, the driver enumerates the patterns of two or
three length bins that fill a sequence, fits how often each is repeated to the
histogram by non-negative least squares (Lawson and Hanson's active sets),
rounds the repeats down, turns every pattern into exact lengths (the last slot
is filled by best fit), and packs what rounding left over by best fit, longest
first, into the open space of patterns and new sequences.  The plan is a list
of exact patterns with repeat counts; its size follows ``cap``, not the input.

Spark then numbers the pieces of each length (hot lengths in many buckets) and looks up
each number's place in the plan.

Defined results: a null text is an empty one (its only token is the end id); a
null id, ties and repeated rows are documents like any other; empty tables give
no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptframe.session import ship_package

from .blocks import BLOCK_BYTES, byte_prefix_sums, span_hash, text_blocks
from .common import materialise, number

CAP = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Entries of each of a worker's token caches before they are emptied (memory only; results are the same).
CACHE_ENTRIES = 600_000
#: Width in tokens of a histogram bin of the least-squares fit.
BIN = 8

# --- tokens -------------------------------------------------------------------------------------------------

_ODD = re.compile("[\x1c-\x1f]")  # split() parts words there, the tokenizer does not
#: Below this code point every character is its own NFC form, and lower case has no context (but for one letter).
_PLAIN_BELOW = "ɐ"
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


#: Bytes by kind, for texts of ASCII and Latin-1 letters: 0 white space, 1 letter, 2 digit, 3 other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _beyond_latin(flat: np.ndarray) -> np.ndarray:
    """Places of bytes that are neither ASCII nor of a Latin-1 letter (two bytes, the first 0xC3)."""
    high = np.flatnonzero(flat >= 128)
    value, before = flat[high], flat[high - 1]
    return high[(value != 0xC3) & ((before != 0xC3) | (value == 0x97) | (value == 0xB7))]


def _word_bounds(flat: np.ndarray, starts: np.ndarray):
    """Lower-cased bytes and (begin, end) of the words as the tokenizer splits them."""
    small = _SMALL[flat]
    second = np.flatnonzero(flat == 0xC3) + 1
    upper = second[flat[second] < 0x9F]
    small[upper] += 32
    kind = _KIND[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[starts] = True
    cut = edge[:-1].copy()
    cut[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    for a in np.flatnonzero((small == 0x27) & cut):  # an apostrophe that starts a word, alone before a letter
        rest = small[a + 1:a + 3]
        if a + 1 < len(flat) and kind[a + 1] == 1 and not edge[a + 1]:
            rest = rest.tobytes() if not edge[a + 2] else rest[:1].tobytes()
            n = next((len(c) for c in _CONTRACTIONS if rest.startswith(c)), 0)
            if n:
                cut[a + 1] = False
                if a + 1 + n < len(flat):
                    cut[a + 1 + n] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(flat))
    word = kind[begin] != 0
    return small, begin[word], end[word]


class TokenBytes:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, splits into words and encodes each word by
    itself, and words recur.  Texts of ASCII and Latin-1 letters are split and
    their words hashed (64 bits) for a whole block at a time; a word's ids are
    looked up by hash, and only a new word goes to the tokenizer's model.  Other
    texts are looked up by their white-space separated parts, and parts with
    characters outside the Latin blocks go to the whole tokenizer.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.hashed: dict[int, bytes] = {}

    def _word(self, w: str) -> bytes:
        shown = w if w.isalpha() and w.isascii() else w.encode().decode("latin-1").translate(_LETTERS)
        found = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(found)}I", *found)

    def column(self, texts: pa.Array):
        """Yield ``(row, ids)`` of every text, ``ids`` as bytes."""
        for first, flat, starts in text_blocks(texts, 4 * BLOCK_BYTES):
            n = len(starts) - 1
            plain = np.ones(n, bool)
            plain[np.searchsorted(starts, _beyond_latin(flat), "right") - 1] = False
            marks = np.flatnonzero((flat[:-1] == 0x3C) & (flat[1:] == 0x7C))  # "<|" may be a special token
            plain[np.searchsorted(starts, marks, "right") - 1] = False
            if not plain.all():
                for i in np.flatnonzero(~plain):
                    yield first + int(i), self([flat[starts[i]:starts[i + 1]].tobytes().decode("utf-8", "replace")])[0]
                sizes = np.where(plain, np.diff(starts), 0)
                flat = flat[np.repeat(plain, np.diff(starts))]
                starts = np.concatenate([[0], np.cumsum(sizes)])
            ids, ends = self._block(flat, starts)
            for i in np.flatnonzero(plain):
                yield first + int(i), ids[ends[i]:ends[i + 1]].tobytes()

    def _block(self, flat: np.ndarray, starts: np.ndarray):
        """Ids of a whole block and each text's bounds in them."""
        if not len(flat):
            return np.zeros(0, "<u4"), np.zeros(len(starts), np.int64)
        small, begin, end = _word_bounds(flat, starts)
        keys, at, word = np.unique(span_hash(byte_prefix_sums(small), begin, end), return_index=True,
                                   return_inverse=True)
        if len(self.hashed) > CACHE_ENTRIES:
            self.hashed.clear()
        known = self.hashed
        found = [known.get(k) for k in keys.tolist()]
        for j, raw in enumerate(found):
            if raw is None:
                w = small[begin[at[j]]:end[at[j]]].tobytes().decode()
                known[int(keys[j])] = found[j] = self._word(w)
        table = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        offset = np.cumsum(size) - size
        each = size[word]
        stop = np.cumsum(each)
        total = int(stop[-1]) if len(stop) else 0
        ids = table[np.repeat(offset[word] - (stop - each), each) + np.arange(total)]
        before = np.concatenate([[0], stop])
        return ids, before[np.searchsorted(begin, starts)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> None:
        if len(self.parts) + len(parts) > CACHE_ENTRIES:
            self.parts.clear()
        if len(self.words) > CACHE_ENTRIES // 2:
            self.words.clear()
        words, known, whole = self.words, self.parts, []
        find = _WORD.findall
        for p in parts:
            if not p.isascii() and (max(p) >= _PLAIN_BELOW or "İ" in p) or "<|" in p:
                whole.append(p)
                continue
            ids = []
            for w in find(p.lower()):
                if (raw := words.get(w)) is None:
                    words[w] = raw = self._word(w)
                ids.append(raw)
            known[p] = ids[0] if len(ids) == 1 else b"".join(ids)
        known.update(zip(whole, self._encode(whole)))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        todo = []
        for i, t in enumerate(texts):
            if not t:
                out[i] = b""
            elif _ODD.search(t):
                out[i] = self._encode([t])[0]
            else:
                todo.append((i, t.split()))
        at = 0
        while at < len(todo):
            group, size = [], 0
            while at < len(todo) and (not group or size + len(todo[at][1]) <= CACHE_ENTRIES // 4):
                group.append(todo[at])
                size += len(todo[at][1])
                at += 1
            new = {p for _, ps in group for p in ps}.difference(self.parts)
            if new:
                if len(self.parts) + len(new) > CACHE_ENTRIES:  # emptied below: learn the whole group
                    new = {p for _, ps in group for p in ps}
                self._learn(list(new))
            get = self.parts.__getitem__
            for i, ps in group:
                out[i] = b"".join(map(get, ps))
        return out


_TOKENS: dict[str | None, TokenBytes] = {}


def _pieces(cap: int, path: str | None, with_ids: bool):
    def run(batches):
        tokens = _TOKENS.get(path) or _TOKENS.setdefault(path, TokenBytes(path))
        end, step = np.asarray([END_ID], "<u4").tobytes(), 4 * cap
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                ids, texts = batch.column(0).slice(first, 2048), batch.column(1).slice(first, 2048)
                row, piece, length, crc, kept = [], [], [], [], []
                for i, raw in tokens.column(texts):
                    raw += end
                    for k in range(0, len(raw), step):
                        part = raw[k:k + step]
                        row.append(i)
                        piece.append(k // step)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(np.frombuffer(part, "<u4").astype(np.int32))
                piece = np.asarray(piece, np.int32)
                cols = {"doc_id": ids.take(pa.array(row, pa.int64())).cast(pa.int64()), "piece": pa.array(piece),
                        "start": pa.array(piece.astype(np.int64) * cap), "length": pa.array(length, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array(kept, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)
    return run


def cut_documents(docs: DataFrame, cap: int = CAP, tokenizer_path: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenised pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids)."""
    ship_package(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        _pieces(cap, tokenizer_path, with_ids), schema)


# --- plan ---------------------------------------------------------------------------------------------------


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """``x >= 0`` that minimises ``|a x - b|``, by active sets.

    ``a`` is wide (thousands of patterns, some hundred bins): gradients go by the residual and only the
    active columns' products are formed, so no matrix of patterns by patterns exists.
    """
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b @ a).max(initial=0)))
    for _ in range(rounds or 4 * a.shape[0]):
        at = np.flatnonzero(active)
        gain = (b - a[:, at] @ x[at]) @ a
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            some = a[:, at]
            z = np.linalg.lstsq(some.T @ some, some.T @ b, rcond=1e-12)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[(x[at] <= 1e-12) & low]
            if not len(gone):
                gone = at[low][:1]
            active[gone] = False
            x[gone] = 0
            if not active.any():
                break
    return x


def patterns(units: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with two or three bins, longest first."""
    out: list[tuple[int, ...]] = [(units - c, c) for c in range(1, units // 2 + 1)]
    for a in range(-(-units // 3), units - 1):
        for b in range(-(-(units - a) // 2), min(a, units - a - 1) + 1):
            out.append((a, b, units - a - b))
    return out


class _Lengths:
    """A histogram that gives out its largest length up to a bound."""

    def __init__(self, hist: np.ndarray):
        self.left = hist.astype(np.int64).copy()

    def largest(self, low: int, high: int) -> int | None:
        found = np.flatnonzero(self.left[max(low, 1):high + 1])
        return int(found[-1]) + max(low, 1) if len(found) else None


def plan(hist: np.ndarray, cap: int = CAP, bin_width: int = BIN) -> list[tuple[tuple[int, ...], int]]:
    """Exact patterns and repeat counts that hold every piece; ``hist[n]`` pieces have length ``n``."""
    lengths = _Lengths(hist)
    out: list[tuple[tuple[int, ...], int]] = []
    if lengths.left[cap]:
        out.append(((cap,), int(lengths.left[cap])))
        lengths.left[cap] = 0
    units = cap // bin_width
    if cap % bin_width == 0 and units >= 3 and lengths.left.any():
        bins = np.zeros(units + 1)
        np.add.at(bins, -(-np.arange(cap + 1) // bin_width), lengths.left)
        shapes = patterns(units)
        a = np.zeros((units + 1, len(shapes)))
        for j, shape in enumerate(shapes):
            np.add.at(a[:, j], list(shape), 1.0)
        repeats = np.floor(nnls(a[1:], bins[1:]) + 1e-9).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            left = int(repeats[j])
            while left > 0:
                used: list[int] = []
                for slot, u in enumerate(shapes[j]):
                    room = cap - sum(used)
                    low = (u - 1) * bin_width + 1
                    last = slot == len(shapes[j]) - 1
                    n = lengths.largest(low, room if last else min(room, u * bin_width))
                    if n is None:
                        break
                    used.append(n)
                    lengths.left[n] -= 1
                for n in used:
                    lengths.left[n] += 1
                if len(used) < len(shapes[j]):
                    break
                times = min(left, *(int(lengths.left[n]) // used.count(n) for n in used))
                if times < 1:
                    break
                for n in used:
                    lengths.left[n] -= times
                out.append((tuple(used), times))
                left -= times
    return _residuals(lengths.left, out, cap)


def _residuals(left: np.ndarray, done: list[tuple[tuple[int, ...], int]], cap: int):
    """Best fit, longest first, of the histogram's rest into open space."""
    room: dict[int, list[list]] = defaultdict(list)
    closed: list[tuple[tuple[int, ...], int]] = []
    spaces = np.zeros(cap + 1, bool)

    def put(pattern: tuple[int, ...], times: int) -> None:
        space = cap - sum(pattern)
        if space <= 0:
            closed.append((pattern, times))
        else:
            room[space].append([pattern, times])
            spaces[space] = True

    for pattern, times in done:
        put(pattern, times)
    for n in range(cap, 0, -1):
        count = int(left[n])
        while count > 0:
            fits = np.flatnonzero(spaces[n:])
            if not len(fits):
                per = cap // n  # as many of this length together as fit
                if count >= per:
                    put((n,) * per, count // per)
                    count %= per
                else:
                    put((n,) * count, 1)
                    count = 0
                continue
            space = int(fits[0]) + n
            entry = room[space][-1]
            times = min(count, entry[1])
            entry[1] -= times
            if not entry[1]:
                room[space].pop()
                spaces[space] = bool(room[space])
            count -= times
            put(entry[0] + (n,), times)
    return closed + [(p, t) for entries in room.values() for p, t in entries if t]


def _places(packed: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number of that length, first sequence, offset), sorted: the plan by length."""
    rows, given, sequence = [], defaultdict(int), 0
    for pattern, times in packed:
        offset = 0
        for n in pattern:
            rows.append((n, given[n], sequence, offset))
            given[n] += times
            offset += n
        sequence += times
    return np.asarray(sorted(rows), np.int64).reshape(-1, 4)


_NUMBERS = 1 << 48


def pack_pieces(pieces: DataFrame, cap: int = CAP) -> DataFrame:
    """``pieces`` (with ``length`` and a stored 64-bit ``spread``) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()  # at most ``cap`` rows
    hist = np.zeros(cap + 1, np.int64)
    for r in counts:
        hist[r["length"]] = r["count"]
    places = _places(plan(hist, cap))
    shared = spark.sparkContext.broadcast(places)
    numbered = number(pieces, "length", [], "spread", "__number")
    names = [c for c in pieces.columns if c != "spread"]

    def locate(frames):
        table = shared.value
        keys = table[:, 0] * _NUMBERS + table[:, 1]
        for f in frames:
            want = f["length"].to_numpy(np.int64) * _NUMBERS + f["__number"].to_numpy(np.int64)
            row = table[np.searchsorted(keys, want, "right") - 1]
            out = {c: f[c] for c in names}
            out["sequence_id"] = row[:, 2] + f["__number"].to_numpy(np.int64) - row[:, 1]
            out["offset"] = row[:, 3]
            yield pd.DataFrame(out)

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c != "spread")
    return numbered.mapInPandas(locate, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, cap: int = CAP, tokenizer_path: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut, tokenise and pack all documents; one row per piece, with its ids if asked for."""
    pieces = cut_documents(docs, cap, tokenizer_path, id_col, text_col, with_ids)
    # Stored once: the histogram, the numbers and the result must see the same pieces, and tokenising is the cost.
    pieces = materialise(pieces.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    return pack_pieces(pieces, cap)
