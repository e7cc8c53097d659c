"""Exact cosine rankings that skip cells of vectors.

Vectors are dealt to the nearest of some centroids (k-means on the sphere,
fitted on a bounded sample), and each cell keeps the largest angle between its
centroid and its vectors.  By the triangle inequality no vector of a cell lies
nearer to a query than their centroid less that angle.  The nearest cells of
each query are read first; of the others only those are read whose bound
reaches the k-th best score found, so no hit is lost however the sample fell.
Tables are sorted by cell, so a skipped cell is neither scored nor, where whole
row groups are skipped, read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import ranking
from corvane.operators.ranking import best_of
from corvane.sources.shared import staged

#: Vectors that the centroids are fitted on, at most about this many, and the most centroids.
SAMPLE_ROWS = 50_000
MOST_CELLS = 1024
ROUNDS = 10
PROBES = 2
#: Angles are not exact; cells and bounds are widened by this much.
SLACK = 1e-6


def _matrix(column: pa.ChunkedArray | pa.Array, size: int | None = None) -> np.ndarray:
    """Unit rows; zeros for missing vectors, zero norms, and lengths other than ``size`` or the greatest."""
    vectors = column.to_pylist()
    size = max((len(v) for v in vectors if v is not None), default=0) if size is None else size
    m = np.array([v if v is not None and len(v) == size else np.zeros(size) for v in vectors], float).reshape(len(vectors), size)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def fit(vectors: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors, a unit row each."""
    vectors = vectors[np.any(vectors != 0, axis=1)]
    if not len(vectors):
        return np.zeros((1, vectors.shape[1]))
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(ROUNDS):
        nearest = np.concatenate([np.argmax(vectors[i : i + 8192] @ centres.T, axis=1) for i in range(0, len(vectors), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        # An empty cell keeps its centroid.
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


@dataclass
class CellIndex:
    """Vectors by cell: ``table (cell, position, vector)``, centroids, and the cosine of each cell's angle."""

    table: DataFrame
    centres: np.ndarray
    nearest: np.ndarray

    @classmethod
    def build(cls, corpus: DataFrame, sample_rows: int = SAMPLE_ROWS, cells: int | None = None) -> CellIndex:
        """From ``corpus (position, vector)``.

        Null vectors, zero vectors and those of a length other than the sample's
        greatest can have no score above 0 and are left out, as
        :func:`corvane.operators.ranking.dense` leaves them out.
        """
        rows = corpus.select("position", F.col("vector").cast("array<double>").alias("vector"))
        n = rows.count()
        share = 1.0 if n <= sample_rows else sample_rows / n
        sample = _matrix(rows.where(F.pmod(F.xxhash64("position"), F.lit(1_000_003)) < share * 1_000_003).select("vector").toArrow().column("vector"))
        centres = fit(sample, max(1, min(MOST_CELLS, int(n**0.5))) if cells is None else cells)
        size = centres.shape[1]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = _matrix(batch.column("vector"), size)
                known = np.any(unit != 0, axis=1)
                unit, position = unit[known], batch.column("position").to_numpy(zero_copy_only=False)[known]
                cosine = unit @ centres.T
                cell = np.argmax(cosine, axis=1) if len(unit) else np.zeros(0, int)
                offsets = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(position), pa.ListArray.from_arrays(offsets, pa.array(unit.ravel())), pa.array(cosine[np.arange(len(unit)), cell])],
                    ["cell", "position", "vector", "cosine"],
                )

        dealt = staged(rows.mapInArrow(assign, "cell int, position long, vector array<double>, cosine double"), "cell-rows")
        # Ranges of cell and position: a cell with a third of all vectors spans several.
        table = staged(dealt.select("cell", "position", "vector").repartitionByRange("cell", "position").sortWithinPartitions("cell", "position"), "cells")
        nearest = np.full(len(centres), 2.0)  # Cells without vectors can have no hit.
        for r in dealt.groupBy("cell").agg(F.min("cosine").alias("least")).collect():
            nearest[r.cell] = r.least
        return cls(table, centres, nearest)

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """What a vector of each cell can score at most: queries by cells."""
        to_centre = np.arccos(np.clip(asked @ self.centres.T, -1, 1))
        width = np.arccos(np.clip(self.nearest, -1, 1)) + SLACK
        bound = np.cos(np.clip(to_centre - width, 0, np.pi)) + SLACK
        return np.where(self.nearest > 1.5, -1.0, bound)

    def _read(self, wanted: np.ndarray, asked: np.ndarray, ids: pa.Array, kind: str, k: int) -> DataFrame:
        """The best ``k`` of the wanted (query, cell) pairs, batch by batch."""
        of_cell = {int(c): np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(axis=0))}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, position = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "position"))
                cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True]) if len(cell) else np.zeros(0, int)
                for i, j in zip(cuts[:-1], cuts[1:]):
                    queries = of_cell.get(int(cell[i]), np.zeros(0, int))
                    for at in range(i, j if len(queries) else i, 2000):
                        past = min(at + 2000, j)
                        found = _matrix(batch.column("vector").slice(at, past - at), asked.shape[1])
                        score = asked[queries] @ found.T
                        q, row = best_of(score, position[at:past], k)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(queries[q])), pa.array(position[at:past][row]), pa.array(score[q, row])], ["query_id", "position", "score"])

        return self.table.where(F.col("cell").isin([int(c) for c in of_cell])).mapInArrow(run, f"query_id {kind}, position long, score double")

    def search(self, queries: DataFrame, k: int, block_queries: int = ranking.BLOCK_QUERIES, probes: int = PROBES) -> tuple[DataFrame, float]:
        """``(query_id, rank, position, score)``, as the full scan ranks, and the share of (query, cell) pairs that were skipped.

        Blocks of at most about ``block_queries`` queries are sent to all tasks.
        """
        kind = queries.schema["query_id"].dataType.simpleString()
        wanted = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        blocks = max(1, -(-wanted.count() // block_queries))
        found, pairs, read = [], 0, 0
        for b in range(blocks):
            block = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
            ids, asked = block.column("query_id").combine_chunks(), _matrix(block.column("vector"), self.centres.shape[1])
            bound = np.where(np.any(asked != 0, axis=1)[:, None], self.bounds(asked), -1.0)
            first = np.zeros(bound.shape, bool)
            best = np.argsort(-bound, axis=1, kind="stable")[:, :probes]
            np.put_along_axis(first, best, True, axis=1)
            first &= bound > 0
            probed = staged(self._read(first, asked, ids, kind, k), "probed")
            floors = {r.query_id: r.low for r in ranking.top_k(probed, k, F.col("position")).groupBy("query_id").agg(F.min("score").alias("low"), F.count("*").alias("n")).where(F.col("n") == k).collect()}
            floor = np.array([floors.get(q, 0.0) for q in ids.to_pylist()])[:, None] if len(ids) else np.zeros((0, 1))
            rest = (bound >= floor - 10.0 ** (1 - ranking.DIGITS)) & (bound > 0) & ~first
            found += [probed, self._read(rest, asked, ids, kind, k)]
            pairs, read = pairs + int((self.nearest < 1.5).sum()) * len(asked), read + int(first.sum() + rest.sum())
        ranked = ranking.top_k(reduce(DataFrame.unionByName, found), k, F.col("position"))
        return ranked.select("query_id", "rank", "position", "score"), 1 - read / pairs if pairs else 0.0
