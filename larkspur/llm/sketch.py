"""A count-min sketch that tells what may occur, or occur twice, merged from partial sketches.

The sketch has two rows of 2 ** bits cells that count to two.  Each task turns its entries into
sparse blocks; blocks are merged in parallel; the driver gets the bits "two or more" (or "one or more") only, which is
2 * 2 ** bits / 8 bytes: bits follow the input up to MAX_BITS, so that is 64 MB at most.  A fuller
sketch overestimates more and misses nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytehash import mixed, tidied

MAX_BITS = 28
BLOCKS = 64
_SHIFT = np.uint64(31)


def sketch_bits(entries: int) -> int:
    """Bits for about so many entries."""
    return min(MAX_BITS, max(16, (4 * max(1, entries) - 1).bit_length()))


def _cells(names: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return [(names & mask).astype(np.int64), ((names >> _SHIFT) & mask).astype(np.int64)]


def repeated_bits(rows: DataFrame, names_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, least: int = 2) -> list[np.ndarray]:
    """For both rows of the sketch, the packed bits of the cells with `least` (1 or 2) entries or more.

    names_of gives the entries of a batch as arrays of well mixed 64-bit numbers.
    """
    block = bits - BLOCKS.bit_length() + 1
    shape = pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [_cells(names, bits) for names in names_of(batch)]
            for row in (0, 1) if seen else ():
                cells, counts = np.unique(np.concatenate([x[row] for x in seen]), return_counts=True)
                counts = np.minimum(counts, 2).astype(np.uint8)
                cut = np.searchsorted(cells, np.arange(BLOCKS + 1) << block)
                some = [i for i in range(BLOCKS) if cut[i] < cut[i + 1]]
                inner = [(cells[cut[i] : cut[i + 1]] - (i << block)).astype(np.uint32).tobytes() for i in some]
                yield pa.record_batch([pa.array([row * BLOCKS + i for i in some], pa.int32()), pa.array(inner, pa.binary()), pa.array([counts[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], schema=shape)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total = sums.setdefault(part, np.zeros(1 << block, dtype=np.uint8))
                at = np.frombuffer(cells, dtype=np.uint32)
                total[at] = np.minimum(total[at] + np.frombuffer(counts, dtype=np.uint8), 2)
        for part, total in sums.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], names=["part", "bits"])

    made = rows.mapInArrow(tidied(partial), "part int, cells binary, counts binary").repartition(BLOCKS // 2, "part").mapInArrow(tidied(merge), "part int, bits binary")
    out = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(2)]
    for r in made.collect():
        row, i = divmod(r["part"], BLOCKS)
        out[row][i << (block - 3) : (i + 1) << (block - 3)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def maybe_repeated(tables: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    """True wherever the estimate reaches what the tables were made for."""
    keep = np.ones(len(names), dtype=bool)
    for table, cells in zip(tables, _cells(names, len(tables[0]).bit_length() + 2)):
        keep &= (table[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
    return keep


def members(ids: DataFrame) -> list[np.ndarray]:
    """Tables for maybe_member() from the one column of whole numbers of ids."""

    def names(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield mixed(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))

    return repeated_bits(ids, names, sketch_bits(ids.count()), 1)


def maybe_member(tables: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    return maybe_repeated(tables, mixed(ids.astype(np.int64).view(np.uint64)))
