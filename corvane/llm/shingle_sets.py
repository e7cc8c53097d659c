"""Groups of texts by the Jaccard similarity of their word shingles.

A SimHash radius cannot decide a similarity: a radius that holds all pairs of
0.8 holds many more that lie below.  So candidates come from the tile comparison
of fingerprints (:func:`corvane.llm.simhash.near_links`), each link a cell of its
two texts, and beside it, for pairs that no small radius holds, from min-hash
bands; inside a cell SimHash fingerprints are compared by exclusive-or and bit
counts, with a radius that a pair of 0.8 does not pass in practice, and what is
left is decided by the true similarity of the shingle sets.  A cell is searched
from one text to the next, and texts that are linked are not compared again, so
a large group of near copies costs about one comparison a text.  Rows with one
text are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected, text_mark
from corvane.llm.shingles import shingle_hashes, simhash
from corvane.llm.staging import join_side, staged

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 agrees in one of 20 bands of 5 with a chance of 0.9996.
BANDS = 20
ROWS = 5
#: Fingerprints of a pair of 0.8 differ in about 10 bits, with a deviation of 3: 26 is over five deviations more.
RADIUS = 26
#: Texts of one cell; a larger bucket is dealt to several cells, each with the same LEADERS, and what these leave apart is compared in full.
TILE = 1024
LEADERS = 8
_SEED = 42


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key a band, from the least of ``rows`` permutations of the hashes each."""
    rng = np.random.default_rng(_SEED)
    flip, odd, mix = (rng.integers(0, 2**64, bands * rows, np.uint64) for _ in range(3))
    odd, mix = odd | np.uint64(1), mix | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[None, i : i + 2048] ^ flip[:, None]) * odd[:, None]).min(axis=1))
    least = (least ^ (least >> np.uint64(29))) * mix
    keys = (least ^ (least >> np.uint64(32))).reshape(bands, rows).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (keys + np.arange(bands, dtype=np.uint64)).view(np.int64)


def shingled(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc_id, mark, fp, keys, grams)``: a row number, fingerprint, band keys and shingle hashes (four bytes each) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, grams = [], [], []
            for text in batch.column(3):
                hashes = shingle_hashes(text.as_py(), shingle, _SEED)
                fps.append(simhash(hashes))
                distinct = np.unique(hashes)
                keys.append(band_keys(distinct))
                grams.append(np.unique(distinct.astype(np.uint32)).tobytes())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.array(fps, np.uint64).view(np.int64)), keys, pa.array(grams, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "mark", "fp", "keys", "grams"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_mark(text_col).alias("mark"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, mark long, fp long, keys array<long>, grams binary")


def similar_links(marks: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one cell whose true similarity reaches the bound."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)]
    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    left = np.arange(len(sets))
    links = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            own = ids[starts[x] : starts[x + 1]]
            # Only fingerprints within the radius, and sizes that allow the similarity, are compared.
            fit = np.bitwise_count(fps[left] ^ fps[x]) <= radius
            fit &= (sizes[left] >= similarity * sizes[x] - 1e-9) & (similarity * sizes[left] <= sizes[x] + 1e-9)
            near = np.zeros(len(left), bool)
            seen[own] = True
            for k in np.flatnonzero(fit).tolist():
                y = left[k]
                common = int(np.count_nonzero(seen[ids[starts[y] : starts[y + 1]]]))
                near[k] = common >= similarity * (sizes[x] + sizes[y] - common) - 1e-9
            seen[own] = False
            found = left[near].tolist()
            links += [(int(marks[x]), int(marks[y])) for y in found]
            queue += found
            left = left[~near]
    return links


def _cell_links(similarity: float, radius: int):
    """Links of all cells of one partition, sorted by cell."""

    def emit(marks: list[int], fps: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        if len(marks) > 1:
            yield from similar_links(np.array(marks), np.array(fps, np.int64).view(np.uint64), sets, similarity, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, marks, fps, sets = None, [], [], []
        for batch in batches:
            links = []
            for cell, mark, fp, grams in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if cell != at:
                    links += emit(marks, fps, sets)
                    at, marks, fps, sets = cell, [], [], []
                marks.append(mark)
                fps.append(fp)
                sets.append(np.frombuffer(grams, np.uint32))
            yield table(links)
        yield table(list(emit(marks, fps, sets)))

    def table(links: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def bucket_members(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """``(key, mark, row, tiles)``: texts that share a band key, a bucket once for all bands that hold the same texts."""
    banded = nodes.select("mark", "row", F.explode("keys").alias("key"))
    counts = banded.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(mark))").alias("texts")).where("n > 1")
    buckets = counts.groupBy("n", "texts").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("tiles"))
    buckets = staged(buckets, "buckets")
    return staged(banded.join(join_side(buckets, buckets.count()), "key").select("key", "mark", "row", "tiles"), "bucket-members")


def first_cells(members: DataFrame) -> DataFrame:
    """``(cell, row)``: whole buckets, or one cell a tile of a large one, with the bucket's leaders in each."""
    small = members.where("tiles = 1").select(F.col("key").alias("cell"), "row")
    large = members.where("tiles > 1")
    first = [F.min_by("mark", F.xxhash64("mark", F.lit(k))) for k in range(LEADERS)]
    leaders = large.groupBy("key").agg(F.array(*first).alias("leaders"))
    dealt = large.join(join_side(leaders, leaders.count()), "key")
    dealt = dealt.select("key", "row", F.explode(F.when(F.array_contains("leaders", F.col("mark")), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(own_tile()))).alias("t"))
    return small.union(dealt.select(F.xxhash64("key", "t").alias("cell"), "row"))


def fingerprint_cells(nodes: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(cell, row)``: every link that ``near`` finds between the fingerprints of ``nodes (row, fp)``, and every text with the first one of its fingerprint, as a cell of two."""
    fps = staged(nodes.groupBy("fp").agg(F.min("row").alias("first"), F.count("*").alias("n")), "text-fingerprints")
    n = fps.count()
    of = lambda end: join_side(fps.select(F.col("fp").alias(end), F.col("first").alias(f"row_{end}")), n)
    links = near(fps.select("fp")).distinct().join(of("a"), "a").join(of("b"), "b").select("row_a", "row_b")
    shared = fps.where("n > 1")
    same = nodes.join(join_side(shared.select("fp", "first"), shared.count()), "fp").where("row <> first").select(F.col("first").alias("row_a"), F.col("row").alias("row_b"))
    both = links.union(same).select(F.xxhash64("row_a", "row_b", F.lit("fingerprints")).alias("cell"), F.array("row_a", "row_b").alias("rows"))
    return both.select("cell", F.explode("rows").alias("row"))


def own_tile():
    return F.pmod(F.xxhash64("mark", F.lit("tile")), F.col("tiles")).cast("int")


def rest_cells(members: DataFrame, roots: DataFrame, tile: int = TILE) -> DataFrame:
    """``(cell, row)``: in each large bucket every text outside its largest group with every other text.

    The first cells have linked most texts of a large bucket already; pairs of
    the largest group need no comparison, and all other pairs get one here.
    """
    large = members.where("tiles > 1").join(join_side(roots, roots.count()), F.col("node") == F.col("mark"), "left")
    large = large.select("key", "mark", "row", "tiles", F.coalesce("root", "mark").alias("root"))
    sizes = large.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    main = main.select("key", "main", F.ceil(F.col("rest") / F.lit(tile)).cast("int").alias("chunks")).where("chunks > 0")
    dealt = large.join(join_side(main, main.count()), "key")
    chunk = F.pmod(F.xxhash64("mark", F.lit("chunk")), F.col("chunks")).cast("int")
    rest = dealt.where(F.col("root") != F.col("main")).select("key", "row", chunk.alias("c"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"))
    every = dealt.select("key", "row", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c"), own_tile().alias("t"))
    return rest.unionByName(every).select(F.xxhash64("key", "t", "c", F.lit("rest")).alias("cell"), "row").distinct()


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, tile: int = TILE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", near: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, mark)`` of all rows, and ``(mark, root)`` of the texts that are linked.

    Two texts are linked if the Jaccard similarity of their word shingles is
    ``similarity`` or more, and share a root if links connect them.  Texts
    without words are one group.  ``near`` links fingerprints.  A pair of 0.8
    that it does not link is missed if it shares none of the bands (a chance of
    0.0004) or its fingerprints differ in more than ``radius`` bits.
    """
    rows = staged(shingled(docs, shingle, id_col, text_col), "shingles")
    nodes = staged(rows.groupBy("mark").agg(F.min("row").alias("row"), F.min_by("keys", "row").alias("keys"), F.min_by("fp", "row").alias("fp")), "texts")
    members = bucket_members(nodes, tile)

    def compared(cells: DataFrame) -> DataFrame:
        # Shingle sets are far larger in memory than their row count suggests: never a broadcast.
        full = cells.join(rows.select("row", "mark", "fp", "grams").hint("merge"), "row").select("cell", "mark", "fp", "grams")
        return full.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links(similarity, radius), "a long, b long")

    cells = first_cells(members)
    if near is not None:
        cells = cells.unionByName(fingerprint_cells(nodes, near))
    links = staged(compared(cells), "similar")
    roots = connected(links)
    rest = staged(rest_cells(members, roots, tile), "rest-cells")
    if rest.limit(1).count():
        roots = connected(links.union(compared(rest)))
    return rows.select("doc_id", "mark"), roots.select(F.col("node").alias("mark"), "root")
