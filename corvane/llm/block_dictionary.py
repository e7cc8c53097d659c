"""Joins between strings of documents and figures about each distinct string.

A row per document and string would be many times the corpus.  Tasks instead
number the distinct strings of a block of documents, so a string crosses the
network once per block that has it, and the figures come back per block as
packed arrays of place and value.  A string is at most once in a block, so
even the most frequent one brings few rows to the task that owns it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACK_ROWS = 400_000


def pack(values: np.ndarray) -> bytes:
    """Compress an integer array; small numbers take little room."""
    import zstandard

    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if not len(values) or (values.min() >= 0 and values.max() <= np.iinfo(t).max) or t is np.int64)
    kind = np.dtype(kind)
    return kind.char.encode() + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    """The array of :func:`pack`, as int64."""
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.dtype(blob[:1].decode())).astype(np.int64)


def packed_by_block(rows: DataFrame) -> DataFrame:
    """``(block, place, value)`` -> ``(block, places, found)`` with packed arrays, several rows a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            block, place, value = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((place, block))
            block, place, value = block[order], place[order], value[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(block[cuts[:-1]]),
                    pa.array([pack(np.diff(place[i:j], prepend=0)) for i, j in spans], pa.binary()),
                    pa.array([pack(value[i:j]) for i, j in spans], pa.binary()),
                ],
                ["block", "places", "found"],
            )

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)))
            size += batch.num_rows
            if size >= PACK_ROWS:
                yield flush()
                held.clear()
                size = 0
        if size:
            yield flush()

    return rows.mapInArrow(run, "block long, places binary, found binary")


def values_of_block(table: pa.Table, n: int) -> np.ndarray:
    """The values of one block, by place, from its rows of :func:`packed_by_block`."""
    out = np.zeros(n, np.int64)
    for places, found in zip(table.column("places").to_pylist(), table.column("found").to_pylist()):
        out[np.cumsum(unpack(places))] = unpack(found)
    return out
