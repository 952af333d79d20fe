"""Numpy views of Arrow text batches: flat bytes, rolling hashes, sliding minima.

A batch of texts is cut into blocks of about ``BLOCK_BYTES`` bytes of whole
texts (a longer text is a block of its own), so memory is bounded by the
longest text, and every step below is vectorised over a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C13 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


class _Powers:
    """``base ** i`` and its inverse modulo 2**64 for i < n, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 4 * BLOCK_BYTES)
            up, down = np.full(size, _BASE), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS = _Powers()


def text_blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES):
    """Yield ``(first_row, flat_bytes, starts)``; ``starts`` has one entry more than rows.

    A null text has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null's slot may hold bytes
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
        data = column.buffers()[2]
        flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, flat[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes (a new array)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums over 64-bit codes, for :func:`span_hash`."""
    up, _ = _POWERS.get(len(codes) + 1)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:len(codes)], out=out[1:])
    return out


def byte_prefix_sums(flat: np.ndarray) -> np.ndarray:
    return prefix_sums(_CODES[flat])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the content of [start, end), the same at any place."""
    _, down = _POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (len(a) - width + 1 of them)."""
    if len(a) < width:
        return a[:0]
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[:-rest], a[rest:]) if rest else a


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(flat: np.ndarray, starts: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: (begin, end, hash, first word of each row)."""
    n = len(flat)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    flat = _LOWER[flat]
    inside = ~_SPACE[flat]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = starts[:-1][(starts[:-1] < n)]
    begin[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    stop = starts[1:][starts[1:] > 0] - 1
    last[stop] = inside[stop]
    b, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return b, e, span_hash(byte_prefix_sums(flat), b, e), np.searchsorted(b, starts)


def signed(a: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs."""
    return a.view(np.int64) if a.flags.c_contiguous else np.ascontiguousarray(a).view(np.int64)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first[0], first[0] + 1, ...`` (``size[0]`` numbers), then those of the next, and so on."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return np.repeat(first - (stop - size), size) + np.arange(total)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching intervals as one, in order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.append(new[1:], len(start)) - 1]


def pack(batches, keep: tuple[str, ...] = ("rid",)):
    """The columns ``keep`` and the text after them, compressed one by one for a shuffle, as ``packed``."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [squeeze(t.as_buffer()) if t.is_valid else None for t in batch.column(len(keep))]
        cols = {c: batch.column(i) for i, c in enumerate(keep)}
        yield pa.RecordBatch.from_pydict(cols | {"packed": pa.array(packed, pa.binary())})


def unpack(column: pa.Array) -> pa.Array:
    """The bytes of texts that :func:`pack` compressed."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([expand(p.as_buffer()) if p.is_valid else None for p in column], pa.large_binary())
