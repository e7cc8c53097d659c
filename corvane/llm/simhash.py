"""SimHash near-duplicates: exact comparison of fingerprints, tile by tile.

Comparing every tile of fingerprints with every other grows with the square of
the corpus, so tiles are formed inside cells.  With radius r the 64 bits are
cut into r + 2 blocks, and two fingerprints that differ in at most r bits agree
in two blocks at least: each pair of blocks gives a key, and a key value is a
cell.  Sorted by cell and population count the fingerprints are cut into tiles,
which are compared by numpy exclusive-or and bit counts; pairs of tiles whose
population counts differ by more than the radius are skipped.  A cell returns a
spanning forest of its links, never all pairs, and the components are found by
Spark joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import shingle_sets
from corvane.llm.components import connected, one_of_each, text_mark
from corvane.llm.shingles import shingle_hashes, simhash
from corvane.llm.staging import join_side, scratch, staged

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a tile, and of a cell that one task compares; a larger cell is dealt to several tasks by population count.
TILE = 256
CELL = 16_384


def fingerprint_of(shingle: int = SHINGLE, seed: int = SEED):
    """A pandas UDF: text -> fingerprint, its 64 bits as a signed long; 0 without words."""

    @F.pandas_udf("long")
    def mark(texts: pd.Series) -> pd.Series:
        found = (simhash(shingle_hashes(None if t is None else t.encode(), shingle, seed)) for t in texts)
        return pd.Series(np.fromiter(found, np.uint64, len(texts)).view(np.int64))

    return mark


def spanning(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of links that connect what all links of the matrix connect.

    The smallest label spreads along the links, and a link is used when it
    lowers a label.  With ``same`` rows and columns are the same nodes.
    """
    if near.sum() <= 64:
        return np.nonzero(near)
    rows, columns = near.shape
    none = rows + columns
    of_row = np.arange(rows)
    of_column = of_row if same else np.arange(rows, none)
    used: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        before = len(used)
        for lower, labels, other, flip in ((near, of_row, of_column, False), (near.T, of_column, of_row, True)):
            reached = np.where(lower, other[None, :], none)
            best = reached.argmin(axis=1)
            least = reached[np.arange(len(best)), best]
            down = np.flatnonzero(least < labels)
            if len(down):
                labels[down] = least[down]
                used.append((best[down], down) if flip else (down, best[down]))
            if same:
                break
        if len(used) == before:
            return tuple(np.concatenate(x) for x in zip(*used))


def tile_links(cells: np.ndarray, pops: np.ndarray, fps: np.ndarray, side: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, int]:
    """Links between fingerprints of the same cell, as two arrays, and the number of skipped tile pairs.

    Rows are sorted by cell and population count.  A tile may hold many small
    cells, and a large cell many tiles.  ``side`` is 0 in a cell that is
    compared with itself; 1 and 2 mark two groups of which only pairs across
    are compared.
    """
    lefts, rights, skipped = [fps[:0]], [fps[:0]], 0
    for i in range(0, len(fps), tile):
        a = slice(i, min(i + tile, len(fps)))
        last_cell, most = cells[a.stop - 1], pops[a.stop - 1]
        for j in range(i, len(fps), tile):
            if j > i:
                if cells[j] != last_cell:
                    break
                if pops[j] - most > radius:
                    # Population counts only rise until the cell ends.
                    skipped += -(-(int(np.searchsorted(cells, last_cell, "right")) - j) // tile)
                    break
            b = slice(j, min(j + tile, len(fps)))
            near = np.bitwise_count(fps[a, None] ^ fps[None, b]) <= radius
            near &= cells[a, None] == cells[None, b]
            if side[a].any():
                near &= (side[a, None] == 0) | (side[a, None] != side[None, b])
            if i == j:
                np.fill_diagonal(near, False)
            if near.any():
                x, y = spanning(near, i == j)
                lefts.append(fps[a][x])
                rights.append(fps[b][y])
    return np.concatenate(lefts), np.concatenate(rights), skipped


def _cell_links(radius: int, tile: int, hold: int = 200_000):
    """Links of all cells of one partition, sorted by cell and population count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def links(parts: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            cells, pops, fps, side = parts
            a, b, _ = tile_links(cells, pops, fps.view(np.uint64), side, radius, tile)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)))
            size += batch.num_rows
            if size >= hold:
                parts = tuple(np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(parts[0], parts[0][-1]))  # the last cell may go on
                yield from links(tuple(x[:cut] for x in parts))
                held = [tuple(x[cut:] for x in parts)]
                size = size - cut if cut else 0
        if held:
            yield from links(tuple(np.concatenate(x) for x in zip(*held)))

    return run


def block_keys(radius: int) -> list[tuple[int, int]]:
    """``(mask, number)`` for every pair of the radius + 2 blocks of the 64 bits; the mask as a signed long."""
    edges = [64 * k // (radius + 2) for k in range(radius + 3)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    found = [x | y for x, y in combinations(masks, 2)]
    return [(m - (1 << 64) if m >> 63 else m, k) for k, m in enumerate(found)]


def near_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, cell_rows: int = CELL) -> DataFrame:
    """``(a, b)``: links that connect whatever distinct fingerprints ``nodes.fp`` lie within the radius."""
    keys = F.array(*[F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask)), F.lit(k)) for mask, k in block_keys(radius)])
    keyed = nodes.select("fp", F.bit_count("fp").alias("pop"), F.explode(keys).alias("key"))
    counts = keyed.groupBy("key", "pop").agg(F.count("*").alias("n"))
    groups = counts.groupBy("key").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("pop", "n"))).alias("pops")).where("total > 1")
    whole = F.col("total") <= cell_rows
    parts = lambda pop: F.ceil(F.coalesce(F.try_element_at(F.col("pops"), pop), F.lit(0)) / F.lit(cell_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.greatest(parts(F.col("pop")), F.lit(1))).cast("int")
    joined = keyed.join(join_side(groups, nodes.count() * len(block_keys(radius))), "key").withColumn("part", F.when(whole, F.lit(0)).otherwise(own))
    mine = F.struct(F.col("pop").alias("p"), F.col("part").alias("t"))

    def cell(other):
        first, second = F.least(mine, other), F.greatest(mine, other)
        side = F.when(mine == other, F.lit(0)).when(mine == first, F.lit(1)).otherwise(F.lit(2))
        return F.struct(F.xxhash64("key", first, second).alias("cell"), side.cast("int").alias("side"))

    others = F.flatten(
        F.transform(
            F.filter(F.sequence(F.col("pop") - radius, F.col("pop") + radius), lambda q: parts(q) > 0),
            lambda q: F.transform(F.sequence(F.lit(0), parts(q) - 1), lambda t: cell(F.struct(q.alias("p"), t.alias("t")))),
        )
    )
    cells = F.when(whole, F.array(F.struct(F.col("key").alias("cell"), F.lit(0).alias("side")))).otherwise(others)
    spread = joined.select(F.explode(cells).alias("c"), "fp", "pop").select("c.cell", F.col("pop").cast("int").alias("pop"), "fp", "c.side")
    ordered = spread.repartition("cell").sortWithinPartitions("cell", "pop")
    return ordered.mapInArrow(_cell_links(radius, tile), "a long, b long")


def fingerprint_roots(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int = TILE, cell_rows: int = CELL, id_col: str = "doc_id", text_col: str = "text", more: tuple = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(doc_id, fp, *more)`` of all rows, ``(fp, rep)`` of all distinct fingerprints, ``(node, root)`` of those that are linked."""
    marked = docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_of(shingle, seed)(F.col(text_col)).alias("fp"), *more)
    marked = staged(marked, "fingerprints", lasting=True)
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-nodes")
    return marked, nodes, connected(near_links(nodes, radius, tile, cell_rows))


def fingerprint_components(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, fp)`` of all rows, and ``(fp, component_id)`` of all distinct fingerprints."""
    with scratch(docs.sparkSession):
        marked, nodes, roots = fingerprint_roots(docs, **options)
        most = roots.count()
        least = nodes.join(join_side(roots, most), F.col("node") == F.col("fp")).groupBy("root").agg(F.min("rep").alias("component_id"))
        linked = roots.join(join_side(least, most), "root").select(F.col("node").alias("fp"), "component_id")
        named = nodes.join(join_side(linked, most), "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
        return marked, staged(named, "components", lasting=True)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    Null and empty texts have fingerprint zero and are linked like any other;
    texts are read whole.  Rows with one fingerprint are one node, so a large
    group of copies costs no comparisons, and rows that repeat appear as often
    as they do.  A null id is never the component's id unless the component has
    no other.  Other columns are not read.  An empty table gives an empty result.
    """
    marked, named = fingerprint_components(docs, **options)
    return marked.join(join_side(named, named.count()), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest id; see :func:`one_of_each`.

    Without ``similarity`` the groups are the components of
    :func:`near_duplicates`.  With it two texts are linked if the Jaccard
    similarity of their word shingles reaches it: an exact check of the links
    of the tile comparison, and of further candidates: see :mod:`shingle_sets`.
    """
    with scratch(docs.sparkSession):
        if similarity is None:
            marked, _, roots = fingerprint_roots(docs, id_col=id_col, text_col=text_col, more=(text_mark(text_col).alias("mark"),), **options)
            rows = marked.select("doc_id", "mark")
            of_text = marked.select("mark", "fp").distinct().join(join_side(roots, roots.count()), F.col("node") == F.col("fp"), "left")
            of_text = of_text.select("mark", F.coalesce("root", "fp").alias("root"))
        else:
            rows, of_text = shingle_sets.similar_texts(docs, similarity, id_col=id_col, text_col=text_col, near=near_links, **options)
        return one_of_each(docs, rows, of_text, id_col, text_col)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
