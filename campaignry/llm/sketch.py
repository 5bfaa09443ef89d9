"""Count-min counters: tasks fill them in numpy, Spark sums them block by block, and what reaches a least count is read as bits.

A cell never holds less than the true count of any key that falls on it (up to MOST, where cells stop), so a key whose
cell stays under a least count has fewer occurrences for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a block, the unit that is sent and summed.
BLOCK = 1 << 16
#: Where cells stop counting.
MOST = 255
#: Cells of a row at most: the bits of one row are 8 MB at this width, whatever the input.
MOST_WIDTH = 1 << 26
SCHEMA = "block long, cells binary"


def width_for(n: float) -> int:
    """The least power of two that is n or more, between BLOCK and MOST_WIDTH. A larger input only fills the cells more."""
    return min(MOST_WIDTH, max(BLOCK, 1 << max(0, int(n) - 1).bit_length()))


class Counters:
    def __init__(self, rows: int, width: int):
        self.cells = np.zeros((rows, width), np.uint8)

    def add(self, row: int, slots: np.ndarray, counts: np.ndarray) -> None:
        """Add counts at slots, which may repeat."""
        import pandas as pd

        at, distinct = pd.factorize(slots)
        here = self.cells[row]
        here[distinct] = np.minimum(here[distinct] + np.bincount(at, counts, len(distinct)), MOST).astype(np.uint8)

    def blocks(self, level: int = 5) -> Iterator[tuple[int, bytes]]:
        """(number, packed cells) of the blocks that hold anything; a higher level packs tighter and takes longer."""
        import zstandard

        packed = zstandard.ZstdCompressor(level=level)
        flat = self.cells.reshape(-1, BLOCK)
        for i in np.flatnonzero(flat.any(axis=1)).tolist():
            yield i, packed.compress(flat[i].tobytes())


def summed_bits(blocks: DataFrame, rows: int, width: int, least: int) -> np.ndarray:
    """The sums of all tasks' blocks as packed bits of (rows, width): whether a cell reaches least (at most MOST)."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpacked = zstandard.ZstdDecompressor()
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = np.frombuffer(unpacked.decompress(cells), np.uint8).astype(np.uint16)
                held[block] = np.minimum(held[block] + here, MOST).astype(np.uint8) if block in held else here.astype(np.uint8)
        for block, cells in held.items():
            if (bits := cells >= least).any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "cells"])

    summed = blocks.where(F.col("block").isNotNull()).select("block", "cells").repartition("block").mapInArrow(run, SCHEMA)
    out = np.zeros((rows * width // BLOCK, BLOCK // 8), np.uint8)
    for r in summed.toLocalIterator():  # rows * width / 8 bytes at most
        out[r["block"]] = np.frombuffer(r["cells"], np.uint8)
    return out.reshape(rows, width // 8)


def reaches(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the cells at slots of one row reached the least count."""
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 == 1
