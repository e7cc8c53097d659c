"""Stored postings of a segment and exact BM25 rankings that skip blocks.

Rows of a segment are cut by position into zones of 1,024 and blocks of 4.  A
posting row has the rows of one zone that have one term, with the term's count
and the text's length in each, and for each block the largest count and the
smallest length: whatever the mean length of the corpus has become since, no
row of the block can score more than these two give.

A zone is searched in one place.  The sum of its terms' bounds is what a block
may score for a query; the best blocks are read first, and then only those that
may still reach the k-th best score found so far.  A few zones are searched
ahead of the others to give all of them such a score to start from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.batches import terms_of
from corvane.operators.bm25 import B, BLOCK_TERMS, K1, idf, query_terms, searchable_text
from corvane.sources.shared import staged

ZONE, BLOCK = 1024, 4
PILOT_SHARE = 16
DIGITS = 9
SCHEMA = "zone long, term string, docs array<int>, tfs array<int>, lengths array<int>, blocks array<int>, most array<int>, shortest array<int>"


def searchable() -> Column:
    return searchable_text(F.col("title"), F.col("metadata.section_title"), F.col("text"))


def build(rows: DataFrame) -> DataFrame:
    """``rows (position, title, metadata, text)`` -> posting rows, zone by zone in order of term.

    Texts are dealt out by zone and read in order, so a task holds the postings
    of one zone, and no row a text and term is ever sorted or shuffled.
    """
    zone, doc = F.shiftrightunsigned("position", 10).alias("zone"), F.col("position").bitwiseAND(F.lit(ZONE - 1)).cast("int").alias("doc")
    texts = rows.select(zone, doc, searchable().alias("text")).repartition("zone").sortWithinPartitions("zone", "doc")
    return texts.mapInArrow(_zones, SCHEMA)


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of ``(zone, doc, text)``, sorted by zone."""
    at, known, parts, length = None, {}, [], np.zeros(ZONE, np.int64)
    for batch in batches:
        for zone, doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), terms_of(batch.column(2))):
            if zone != at:
                yield _zone_rows(at, known, parts, length)
                at, known, parts, length = zone, {}, [], np.zeros(ZONE, np.int64)
            length[doc] = len(words)
            term, tf = np.unique(np.array([known.setdefault(w, len(known)) for w in words], np.int64), return_counts=True)
            parts.append((term, np.full(len(term), doc), tf))
    yield _zone_rows(at, known, parts, length)


def _zone_rows(zone: int | None, known: dict[bytes, int], parts: list[tuple[np.ndarray, ...]], length: np.ndarray) -> pa.RecordBatch:
    """A row a term of one zone."""
    term, doc, tf = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    names = sorted(known)
    place = np.zeros(len(known), np.int64)
    place[[known[t] for t in names]] = np.arange(len(names))
    term = place[term]
    order = np.lexsort((doc, term))
    term, doc, tf = term[order], doc[order], tf[order]
    size = length[doc]
    # Where a block of a term begins among its rows, and a term among these blocks.
    block = np.flatnonzero(np.diff(term * ZONE + doc // BLOCK, prepend=-1))
    lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))
    of_rows, of_blocks = (np.searchsorted(x, np.arange(len(names) + 1)) for x in (term, term[block]))
    most, shortest = (np.maximum.reduceat(tf, block), np.minimum.reduceat(size, block)) if len(block) else (tf, size)
    columns = [lists(of_rows, x) for x in (doc, tf, size)] + [lists(of_blocks, x) for x in (doc[block] // BLOCK, most, shortest)]
    return pa.RecordBatch.from_arrays([pa.array([zone] * len(names), pa.int64()), pa.array([t.decode() for t in names], pa.string()), *columns], [c.split()[0] for c in SCHEMA.split(", ")])


def sizes(rows: DataFrame) -> DataFrame:
    """One row: number of rows and of their terms."""
    return rows.agg(F.count("*"), F.coalesce(F.sum(F.size(T.terms(searchable()))), F.lit(0)))


def distinct_terms(rows: DataFrame) -> DataFrame:
    """``(term)``: a row for every row and each of its distinct terms."""
    return rows.select(F.explode_outer(F.array_distinct(T.terms(searchable()))).alias("term")).where("term IS NOT NULL")


def found_schema(kind: str) -> str:
    return f"query_id {kind}, position long, score double, blocks long, read long"


def _pieces(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end)."""
    n = ends - starts
    return np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))


def _zone_search(terms: list[tuple], weights: list[np.ndarray], k: int, average: float, dead: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The best ``k`` rows of a zone for one query: rows, scores, blocks that have a term, blocks read (both counted by term).

    ``terms``: the posting arrays of the query's terms in this zone.
    """

    def weight(tf, length):
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))

    n_blocks = ZONE // BLOCK
    bound = np.zeros(n_blocks)
    for (_, _, _, blocks, most, shortest, _), w in zip(terms, weights):
        bound[blocks] += w * weight(most, shortest)
    score = np.zeros(ZONE)
    unread = bound > 0
    total, read = sum(len(t[3]) for t in terms), 0

    def score_blocks(chosen: np.ndarray) -> None:
        nonlocal read
        for (docs, tfs, lengths, blocks, _, _, cuts), w in zip(terms, weights):
            at = np.flatnonzero(chosen[blocks])
            if len(at):
                read += len(at)
                x = _pieces(cuts[at], cuts[at + 1])
                score[docs[x]] += w * weight(tfs[x], lengths[x])
        unread[chosen] = False

    def kth() -> float:
        live = score[score > 0]
        return float(np.partition(live, len(live) - k)[len(live) - k]) if len(live) >= k else 0.0

    # A bound may differ from the sum of the same scores by rounding.
    slack = 10.0 ** (1 - DIGITS)
    step = -(-k // BLOCK)
    while True:
        may = unread & (bound >= floor - slack)
        if not may.any():
            break
        best = np.argsort(-np.where(may, bound, -1.0), kind="stable")[:step]
        chosen = np.zeros(n_blocks, bool)
        chosen[best[may[best]]] = True
        score_blocks(chosen)
        score[dead] = 0.0
        floor = max(floor, kth())
        step += -(-k // BLOCK)
    rows = np.flatnonzero(score > 0)
    rows = rows[np.lexsort((rows, -np.round(score[rows], DIGITS)))][:k]
    return rows, score[rows], total, read


def search(stored: DataFrame, dead: DataFrame, statistics: DataFrame, queries: DataFrame, n: int, average: float, k: int, span: int, block_terms: int = BLOCK_TERMS, pilot: int = PILOT_SHARE) -> DataFrame:
    """The best ``k`` rows of each zone that may be among the best of all.

    ``stored (segment, zone, term, ...)``, ``dead (segment, position)``,
    ``statistics (term, df)`` and ``queries (query_id, text)`` -> ``(query_id,
    position, score, blocks, read)`` with positions counted from ``segment *
    span``.  Rows without a position count the posting blocks that a zone has
    for a query and those that were read.  Scores are above 0.
    """
    spark = queries.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = staged(query_terms(queries), "asked-terms")
    if k < 1 or average <= 0:
        return spark.createDataFrame([], found_schema(kind))
    terms = asked.select("term").distinct()
    # One block of query terms has a bounded number of rows; so has what is known about them.
    n_terms = asked.count()
    of_terms = lambda df: df.join(F.broadcast(terms) if n_terms <= block_terms else terms.hint("merge"), "term", "left_semi")
    weights = staged(asked.join(of_terms(statistics), "term").select("query_id", "term", (F.col("qtf") * idf(F.lit(n), F.col("df"))).alias("w")), "asked-weights")
    blocks = max(1, -(-n_terms // block_terms))
    gone = dead.select("segment", F.shiftrightunsigned("position", 10).alias("zone"), F.col("position").bitwiseAND(F.lit(ZONE - 1)).cast("int").alias("doc"))
    gone = gone.groupBy("segment", "zone").agg(F.collect_list("doc").alias("dead"))

    found = []
    for b in range(blocks):
        block = weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        of_block = stored.join(F.broadcast(block.select("term").distinct()), "term", "left_semi")
        if pilot > 1:
            # The first zone of each part of the oldest segment and every 16th after it; k rows a query and zone come back.
            first = (F.col("segment") == 0) & (F.pmod("zone", F.lit(pilot)) == 0)
            ahead = staged(_searched(of_block.where(first), gone, block, None, average, k, span, kind), "pilot")
            order = Window.partitionBy("query_id").orderBy(F.desc("score"))
            floors = ahead.where("position IS NOT NULL").withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("query_id", F.col("score").alias("floor"))
            found += [ahead, _searched(of_block.where(~first), gone, block, floors, average, k, span, kind)]
        else:
            found.append(_searched(of_block, gone, block, None, average, k, span, kind))
    return reduce(DataFrame.unionByName, found)


def _searched(stored: DataFrame, gone: DataFrame, block: DataFrame, floors: DataFrame | None, average: float, k: int, span: int, kind: str) -> DataFrame:
    # Bounded by the block: its queries, terms, weights and floors.
    table = block.orderBy("query_id").toArrow()
    ids = table.column("query_id").combine_chunks().dictionary_encode() if len(table) else pa.array([], table.schema.field("query_id").type).dictionary_encode()
    number, names = ids.indices.to_numpy(zero_copy_only=False), ids.dictionary
    wanted: dict[str, list] = {}
    for q, term, w in zip(number.tolist(), table.column("term").to_pylist(), table.column("w").to_pylist()):
        wanted.setdefault(term, []).append((q, w))
    floor = np.zeros(len(names))
    if floors is not None:
        given = floors.toArrow()
        at = {name: i for i, name in enumerate(names.to_pylist())}
        for name, low in zip(given.column("query_id").to_pylist(), given.column("floor").to_pylist()):
            floor[at[name]] = low

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        segment, zone = (x.as_py() for x in key)
        dead = np.unique(np.concatenate([np.asarray(x, np.int64) for x in right.column("dead").to_pylist()])) if right.num_rows else np.zeros(0, np.int64)
        of_query: dict[int, tuple[list, list]] = {}
        columns = [left.column(c).combine_chunks() for c in ("docs", "tfs", "lengths", "blocks", "most", "shortest")]
        for i, term in enumerate(left.column("term").to_pylist()):
            docs, tfs, lengths, blocks, most, shortest = (c[i].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
            cuts = np.r_[np.searchsorted(docs, blocks * BLOCK), len(docs)]
            arrays = (docs, tfs, lengths, blocks, most, shortest, cuts)
            for q, w in wanted.get(term, ()):
                terms, weights = of_query.setdefault(q, ([], []))
                terms.append(arrays)
                weights.append(w)
        out: list[list] = [[], [], [], [], []]
        for q, (terms, weights) in of_query.items():
            rows, scores, total, read = _zone_search(terms, weights, k, average, dead, float(floor[q]))
            out[0] += [q] * (len(rows) + 1)
            out[1] += [*(segment * span + zone * ZONE + rows).tolist(), None]
            out[2] += [*scores.tolist(), None]
            out[3] += [0] * len(rows) + [total]
            out[4] += [0] * len(rows) + [read]
        return pa.table([names.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], ["query_id", "position", "score", "blocks", "read"])

    return stored.groupBy("segment", "zone").cogroup(gone.groupBy("segment", "zone")).applyInArrow(run, found_schema(kind))


def best(found: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of ``found (query_id, position, score)``; equal scores go by path and chunk number of ``keys``."""
    rounded = F.round("score", DIGITS)
    near = staged(found.withColumn("nth", F.rank().over(Window.partitionBy("query_id").orderBy(rounded.desc()))).where(F.col("nth") <= k).drop("nth"), "near-best")
    n = near.count()
    small = F.broadcast(near) if n <= BLOCK_TERMS else near.hint("merge")
    order = Window.partitionBy("query_id").orderBy(rounded.desc(), "source_path", "chunk_index", "chunk_id")
    ranked = keys.join(small, "position").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "position", "chunk_id", "score")
