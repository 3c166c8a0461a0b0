"""Words of a batch of texts as arrays: found by their bytes, numbered through one dictionary.

For the operators that look at every word of every text. Nothing is made for a single word in
Python; a slice of a batch holds SLICE_BYTES of text, or one text where that is longer.

Cases: a null text has no words. Words are classes of bytes, so a text need not be valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task looks at together.
SLICE_BYTES = 4_000_000

_ALL = np.arange(256)
#: Bytes of words between ASCII white space, and of words of digits, letters a-z and all beyond ASCII.
NOT_SPACE = (_ALL != 0x20) & ((_ALL < 0x09) | (_ALL > 0x0D))
LETTERS = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
#: Every byte, with A-Z in lower case.
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 0x20, _ALL).astype(np.uint8)


class Words(NamedTuple):
    """first: the number of each text's first word, and of the end; ids: each word's place in distinct."""

    first: np.ndarray
    ids: np.ndarray
    distinct: pa.BinaryArray


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (and the last ends)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and offsets[-1] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def numbered_pieces(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, pa.BinaryArray]:
    """Pieces that lie one after the other in data: each one's number, and the distinct pieces."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return np.asarray(pieces.indices), pieces.dictionary


def words_of(texts: pa.Array, inside: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """The maximal runs of bytes that are inside, after fold has replaced bytes."""
    data, offsets = bytes_of(texts)
    data = data if fold is None else fold[data]
    mask = inside[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    starts = mask.copy()
    starts[1:] &= ~mask[:-1] | begins[1:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | begins[1:-1]
    at = np.flatnonzero(starts)
    ids, distinct = numbered_pieces(data[mask], np.flatnonzero(ends) + 1 - at)
    return Words(np.searchsorted(at, offsets), ids, distinct)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to about so many bytes of text in a column, one row at least."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        at, start = np.concatenate([[0], np.cumsum(size)]), 0
        while start < len(batch):
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
