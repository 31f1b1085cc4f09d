"""Word and shingle hashes of whole text columns, computed on their UTF-8 bytes with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D (bytes inside longer UTF-8 sequences are
never among these).  A word's hash is a polynomial over a random table of byte values, mixed to 64
bits; it depends on the word alone, so every machine computes the same.  Work goes in pieces of a
few MB, so memory stays bounded however long a text or a batch is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time, if no single text or word is longer.
PIECE = 512 << 10

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = _U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work over batches, giving freed memory back to the system at its end: workers are kept, and an idle one would hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and the offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more entry at the end)."""
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = word[inner]  # words end with their text
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, dtype=bool)
    stops[1:] = word
    stops[1:-1] &= ~word[1:] | begins[1:]
    stops = np.flatnonzero(stops)
    return starts, stops, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; `lower` takes A-Z as a-z."""
    table = _BYTE[_LOWER] if lower else _BYTE
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + PIECE, side="right")))
        lo, hi = starts[at], stops[end - 1]
        upto = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(table[data[lo:hi]] * powers(_BASE, hi - lo), out=upto[1:])
        a, b = starts[at:end] - lo, stops[at:end] - lo
        out[at:end] = (upto[b] - upto[a]) * powers(_INVERSE, hi - lo + 1)[a] + (b - a).astype(np.uint64) * _STEP
        at = end
    return mixed(out)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every `size` consecutive entries; fewer entries give none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if size <= 8:
        out = words[:n].copy()
        for i in range(1, size):
            out = out * _BASE + words[i : i + n]
        return mixed(out)
    upto = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(_BASE, len(words)), out=upto[1:])
    return mixed((upto[size:] - upto[:-size]) * powers(_INVERSE, n))
