"""Arrow views of the words of a text column: one dictionary a block, words as its indices.

A column is cut into blocks of about ``BLOCK_BYTES`` bytes of whole texts (a longer text is a block of its
own), so memory is bounded by the longest text.  Words are compared as dictionary indices, so two
words are equal just when their bytes are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
#: Words are parted by runs of these.
SPACES = r"[\x20\x09-\x0D]+"


class Words(NamedTuple):
    """Words of a block: ``ids`` index ``dictionary``; row ``r`` has the words ``starts[r]:starts[r + 1]``."""

    dictionary: pa.Array
    ids: np.ndarray
    starts: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The row of every word."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def text_slices(column: pa.Array, size: int = BLOCK_BYTES):
    """``(first row, texts)`` slices of about ``size`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        before = int(ends[row - 1]) if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + size, "right")))
        yield row, texts.slice(row, stop - row)
        row = stop


def _parts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The flattened values of a list array and every row's first place among them."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return pc.list_flatten(lists), offsets - offsets[0]


def split_words(texts: pa.Array, separators: str = SPACES) -> Words:
    """Words of every text, in order; the empty strings beside a leading or trailing separator are none."""
    flat, starts = _parts(pc.split_pattern_regex(texts, separators))
    coded = flat.dictionary_encode()
    ids, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    empty = pc.index(words, pa.scalar("", words.type)).as_py() if len(words) else -1
    if empty >= 0:
        real = ids != empty
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        ids = ids[real]
    return Words(words, ids, starts)


def split_lines(texts: pa.Array) -> Words:
    """Lines parted by one line feed, empty ones included, as :class:`Words`."""
    flat, starts = _parts(pc.split_pattern(texts, "\n"))
    coded = flat.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), starts)


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of every row's values (integers stay integers)."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype != bool else np.int64), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def joined(words: Words, keep: np.ndarray, by: str = " ") -> pa.Array:
    """The words with ``keep`` of every row, joined by ``by``."""
    starts = np.concatenate([[0], np.cumsum(keep)])[words.starts]
    values = words.dictionary.take(pa.array(words.ids[keep]))
    lists = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), values)
    return pc.binary_join(lists, pa.scalar(by, values.type))
