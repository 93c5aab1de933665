"""Terms of texts, cut at ASCII bytes, a few MB of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are cut at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def byte_table(digits: bool) -> np.ndarray:
    """What a byte of a term becomes: A-Z lower-cased, other letters, digits (if wanted) and all bytes past ASCII as they are; 0 for what separates terms."""
    table = np.zeros(256, np.uint8)
    for low, high in ((0x61, 0x7A), (0x80, 0xFF), *([(0x30, 0x39)] if digits else [])):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


LETTERS, WORDS = byte_table(False), byte_table(True)


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of ``texts`` (no nulls) of about SLICE_BYTES."""
    sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, done = 0, 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(sizes, done + SLICE_BYTES, "right")))
        yield lo, hi
        lo, done = hi, int(sizes[hi - 1])


def cut(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The terms of ``texts`` (strings, no nulls), in order: each one's text number and term code, and the terms by code."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(bounds[-1] - bounds[0])
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    folded = table[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]]
    bounds -= bounds[0]
    inside = folded != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = bounds[:-1] < bounds[1:]  # a term ends with its text
    first[bounds[:-1][full]] = inside[bounds[:-1][full]]
    last[bounds[1:][full] - 1] = inside[bounds[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    held = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(folded[inside])).dictionary_encode()
    return np.searchsorted(bounds, starts, "right") - 1, held.indices.to_numpy().astype(np.int64), held.dictionary


def counted(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Distinct (text number, term code) of ``texts`` and how often each occurs, and the terms by code."""
    rows, codes, names = cut(texts, table)
    wide = max(len(names), 1)
    keys, times = np.unique(rows * wide + codes, return_counts=True)
    return keys // wide, keys % wide, times, names
