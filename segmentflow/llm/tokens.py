"""Words of whole texts as numpy and Arrow arrays, found by classes of bytes.

Bytes from 128 on belong to words, so UTF-8 characters stay whole.  Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 22
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, a-z and everything beyond ASCII.
ALPHANUMERIC = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class Words(NamedTuple):
    """Words in order: row, first and past-the-last byte in data, the lower-cased bytes of all rows."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def array(self) -> pa.Array:
        """The words as one Arrow array."""
        sizes = self.end - self.start
        offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=offsets[1:])
        edge = np.zeros(len(self.data) + 1, dtype=np.int8)
        edge[self.start] += 1
        edge[self.end] -= 1  # each of both holds a place once
        own = np.ascontiguousarray(self.data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(own)])


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, offsets) of runs of rows of at most so many bytes, or of one longer row."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, _LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """The maximal runs of word bytes; no run crosses two rows."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = is_word[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[1 + cuts]
    ends[cuts - 1] = inside[cuts]
    start = np.flatnonzero(begins)
    return Words(np.searchsorted(offsets, start, side="right") - 1, start, np.flatnonzero(ends) + 1, data)
