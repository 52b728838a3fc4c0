"""Words of Arrow text columns by array operations on their bytes: no Python object is made for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Words of letters: all but [\x00-\x40\x5B-\x60\x7B-\x7F], so that any character beyond ASCII is one.
LETTER_WORDS = LETTERS + LETTERS.upper() + bytes(range(128, 256))
#: Words of letters and digits: all but [\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased.
ALPHANUMERIC_WORDS = LETTER_WORDS + b"0123456789"
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def texts_of(column: pa.Array) -> pa.Array:
    """The column as 64-bit strings; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def word_arrays(texts: pa.Array, of: bytes = ALPHANUMERIC_WORDS) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, A-Z lower-cased, and how many each text has; a word never crosses texts."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(of, np.uint8))[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    kept = np.cumsum(inside, dtype=np.int64)
    ends = np.append(kept[at] - 1, kept[-1] if len(kept) else 0)
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[raw[inside]])])
    return words, np.diff(np.searchsorted(at, offsets))


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches whose texts in one column have `most` bytes together, or a single row that has more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, most + (ends[low - 1] if low else 0), "right")))
            yield batch.slice(low, high - low)
            low = high
