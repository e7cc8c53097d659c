"""Ranking a set of queries against a corpus: dense, blended, lexical, and rank fusion.

Frames: ``queries (query_id, text, vector)``; ``corpus (position, chunk_id,
text, searchable, metadata_text, vector)``, of which each ranker reads what it
needs.  Rankings are ``(query_id, rank, position, chunk_id, score)``.  Scores
are compared at nine decimals, so the order of additions decides no tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.config import RetrievalSettings
from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.functions.batches import CELLS, DIGITS, LOOKUPS, PAIRS, SLACK, Asked, Best, Postings, Words, growing, searching
from corvane.operators import bm25
from corvane.operators.embedding import Tokens, hash_vectors
from corvane.sources.shared import staged, writing

#: Ranks ``queries`` to a depth from stored postings, as :func:`lexical` does from a corpus.
StoredRanking = Callable[[DataFrame, int], DataFrame]
BLOCK_QUERIES = 2048
#: Numbers in the vectors of a block of queries that a scan sends to all tasks.
BLOCK_NUMBERS = 1 << 22


def top_k(scored: DataFrame, k: int, *ties: Column) -> DataFrame:
    """The ``k`` best rows of each query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of length 1; zeros for missing vectors, other lengths and zero norms."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    size = int(lengths.max(initial=0))
    m = np.zeros((len(column), size))
    values = column.values.slice(column.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False) if size else np.zeros(0)
    whole = (lengths == size) & column.is_valid().to_numpy(zero_copy_only=False)
    m[whole] = values[np.repeat(whole, lengths)].reshape(-1, size) if size else 0.0
    return _unit_rows(m)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def best_of(score: np.ndarray, position: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the ``k`` best positive scores of each query; equal ones by position."""
    rounded = np.round(score, DIGITS)
    if score.shape[1] > k:
        # Rows at the k-th score stay until positions decide.
        least = np.partition(rounded, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
    else:
        least = np.zeros((len(score), 1))
    q, row = np.nonzero((rounded >= least) & (score > 0))
    order = np.lexsort((position[row], -rounded[q, row], q))
    q, row = q[order], row[order]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    return q[nth < k], row[nth < k]


def _cosines(asked: np.ndarray, found: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit rows, some at once."""
    out = np.zeros(len(query))
    step = max(1, LOOKUPS // max(asked.shape[1], 1))
    for i in range(0, len(query) if asked.shape[1] == found.shape[1] else 0, step):
        out[i : i + step] = np.einsum("ij,ij->i", asked[query[i : i + step]], found[row[i : i + step]])
    return out


def _scan(corpus: DataFrame, queries: DataFrame, depths: dict[str, int], block_queries: int | None = None, block_terms: int = bm25.BLOCK_TERMS, part: DataFrame | None = None) -> DataFrame:
    """Exact scan: ``(ranker, query_id, position, score)``, the best rows of each task for ``dense``, ``blended`` or both.

    Blocks of queries of a bounded size go to all tasks; ``depths`` says how
    many rows each ranker keeps.  A corpus without vectors gets hash vectors of
    its texts in the scan.  A task works scores out in single precision for a
    piece of its rows and some queries at once, cosines once for both rankers,
    and those that may be among the best exactly.  A ``part`` of the corpus is
    scanned first for floors, as in :func:`corvane.operators.bm25.best`.
    """
    lexical, hashed = "blended" in depths, "vector" not in corpus.columns
    vector = F.col("vector").cast("array<double>").alias("vector")
    texts = (["text"] if lexical or hashed else []) + (["metadata_text"] if lexical else [])
    wanted = queries.select("query_id", vector, *([T.distinct_terms(F.col("text")).alias("terms")] if lexical else []))
    read = lambda rows: rows.select("position", *([] if hashed else [vector]), *texts)
    rows, first = read(corpus), None if part is None else read(part)
    n, numbers, n_terms = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0)) if lexical else F.lit(0)).first()
    blocks = max(1, -(-numbers // BLOCK_NUMBERS) if block_queries is None else -(-n // block_queries), -(-n_terms // block_terms))
    if blocks > 1:
        # Each block reads the rows again, so what they are made of is worked out once.
        rows, wanted = staged(rows, "scan-rows"), staged(wanted, "scan-queries")
    spark, kind = queries.sparkSession, queries.schema["query_id"].dataType.simpleString()
    place = corpus.schema["position"].dataType
    arrow, schema = to_arrow_type(place), f"ranker string, number long, position {place.simpleString()}, score double"
    rows = bm25.few_tasks(rows)
    at = 1 if hashed else 2

    def scan(block: pa.Table) -> DataFrame:
        asked = _unit(block.column("vector"))
        known: dict[bytes, int] = {}
        lists = block.column("terms").to_pylist() if lexical else [[]] * len(asked)
        sizes = np.array([len(x) for x in lists], np.int64)
        term = np.array([known.setdefault(t.encode(), len(known)) for x in lists for t in x], np.int64)
        common = Asked(np.repeat(np.arange(len(sizes)), sizes), term, np.ones(len(term)), len(sizes))
        of = np.maximum(sizes, 1).astype(float)
        # Queries that no row can answer.
        idle = {"dense": ~asked.any(axis=1), "blended": ~asked.any(axis=1) & (sizes == 0)}

        def keeping(floor: dict[str, np.ndarray]):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = {ranker: Best(len(asked), k, floor.get(ranker)) for ranker, k in depths.items()}
                words, tokens, single, shares = Words(known), Tokens(), asked.astype(np.float32), common.weighed(1.0 / of[common.query])
                slack = (asked.shape[1] + 8) * float(np.finfo(np.float32).eps) + (shares.share if lexical else 0.0)
                step = max(1, CELLS // max(len(asked), 1))
                parts = growing(batches, at) if texts else (batch.slice(i, max(step, 1024)) for batch in batches for i in range(0, batch.num_rows, max(step, 1024)))
                for piece in parts if len(asked) else ():
                    position = piece.column(0).to_numpy(zero_copy_only=False)
                    found = _unit_rows(hash_vectors(piece.column(1).to_pylist(), tokens)) if hashed else _unit(piece.column(1))
                    turned = np.ascontiguousarray(found.astype(np.float32).T)
                    has = [Postings(piece.column(at + c), words) for c in range(2)] if lexical else []
                    ones = [np.ones(len(p.key)) for p in has]
                    sums = zip(*(shares.sums(p, x) for p, x in zip(has, ones))) if lexical else None
                    some = max(1, CELLS // max(len(position), 1))

                    def scores() -> Iterator[tuple[int, dict[str, np.ndarray]]]:
                        for a in range(0, len(asked), some):
                            those = single[a : a + some]
                            cosine = those @ turned if asked.shape[1] == found.shape[1] else np.zeros((len(those), len(position)), np.float32)
                            score = {"dense": cosine}
                            if lexical:
                                (_, lex), (_, meta) = next(sums)
                                score["blended"] = np.maximum(np.maximum(cosine, lex), np.float32(V.DENSE_WEIGHT) * cosine + np.float32(V.LEXICAL_WEIGHT) * lex + np.float32(V.METADATA_WEIGHT) * meta)
                            for ranker in depths:
                                score[ranker][idle[ranker][a : a + some]] = -1.0
                            yield a, score

                    def put(ranker: str, query: np.ndarray, row: np.ndarray) -> None:
                        exact = _cosines(asked, found, query, row)
                        if ranker == "blended":
                            lex, meta = (common.exact(p, x, query, row) / of[query] for p, x in zip(has, ones))
                            exact = np.maximum(np.maximum(exact, lex), V.DENSE_WEIGHT * exact + V.LEXICAL_WEIGHT * lex + V.METADATA_WEIGHT * meta)
                        good = (exact > 0) & (exact >= best[ranker].floor[query] - SLACK)
                        if good.any():
                            best[ranker].add(query[good], position[row[good]], exact[good])

                    may: dict[str, list] = {ranker: [] for ranker in depths}
                    for a, score in scores():
                        for ranker in depths:
                            may[ranker].append(best[ranker].reaching(score[ranker], a, 0.0, slack, -0.5))
                            if a + some >= len(asked) or sum(len(query) for query, _ in may[ranker]) > PAIRS:
                                put(ranker, *(np.concatenate(x) for x in zip(*may[ranker])))
                                may[ranker] = []
                for ranker, b in best.items():
                    yield pa.RecordBatch.from_arrays([pa.array([ranker] * len(b.query), pa.string()), pa.array(b.query), pa.array(b.position).cast(arrow), pa.array(b.score)], ["ranker", "number", "position", "score"])

            return run

        floor: dict[str, np.ndarray] = {}
        if first is not None:
            # A task a core, as each sends its best rows of all queries.
            ahead = first.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(keeping({}), schema)
            deep = F.create_map(*[F.lit(x) for pair in depths.items() for x in pair])[F.col("ranker")]
            with writing(spark):
                kth = ahead.groupBy("ranker", "number").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= deep).select("ranker", "number", F.element_at("s", deep).alias("score")).toArrow()
            floor = {ranker: np.zeros(len(asked)) for ranker in depths}
            for ranker, number, score in zip(*(c.to_pylist() for c in kth.columns)):
                floor[ranker][number] = score
        names = spark.createDataFrame(pa.table({"number": pa.array(np.arange(len(asked))), "query_id": block.column("query_id").combine_chunks()}), f"number long, query_id {kind}")
        return rows.mapInArrow(keeping(floor), schema).join(F.broadcast(names), "number").select("ranker", "query_id", "position", "score")

    return reduce(DataFrame.unionByName, [scan(wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()) for b in range(blocks)])


def scanned(corpus: DataFrame, queries: DataFrame, depths: dict[str, int], block_queries: int | None = None, part: DataFrame | None = None) -> DataFrame:
    """``(ranker, query_id, rank, position, score)`` of several exact rankings by one scan of the corpus; ``part`` of it, where given, is scanned first, so that less leaves the tasks."""
    order = Window.partitionBy("ranker", "query_id").orderBy(F.round("score", DIGITS).desc(), "position")
    found = _scan(corpus, queries, depths, block_queries, part=part).withColumn("rank", F.row_number().over(order))
    deep = reduce(lambda x, y: x | y, [(F.col("ranker") == r) & (F.col("rank") <= k) for r, k in depths.items()])
    return found.where(deep)


def dense(corpus: DataFrame, queries: DataFrame, k: int, block_queries: int | None = None) -> DataFrame:
    """Cosine ranking; only similarities above 0."""
    return _named(scanned(corpus, queries, {"dense": k}, block_queries), corpus)


def blended(corpus: DataFrame, queries: DataFrame, k: int, block_queries: int | None = None) -> DataFrame:
    """Ranking by the best of cosine, term overlap and their weighted sum with the metadata overlap."""
    return _named(scanned(corpus, queries, {"blended": k}, block_queries), corpus)


def lexical(corpus: DataFrame, queries: DataFrame, k: int, part: DataFrame | None = None) -> DataFrame:
    """BM25 ranking over the searchable text; ``part`` of the corpus, where given, is scored first, so that less leaves the tasks."""
    text = "searchable" if "searchable" in corpus.columns else "text"
    return _named(top_k(bm25.best(corpus, queries, k, text, part=part), k, F.col("position")), corpus)


def overlap(corpus: DataFrame, queries: DataFrame, k: int, block_terms: int = bm25.BLOCK_TERMS) -> DataFrame:
    """Ranking by the share of a query's distinct terms that a text has: ``(query_id, rank, position, score)``.

    Each task reads its texts once for a block of query terms and keeps the best
    rows of every query, so only these are shuffled.
    """
    texts = bm25.few_tasks(corpus.select("position", "text"))
    terms = queries.select("query_id", F.explode(T.distinct_terms(F.col("text"))).alias("term"))
    found = []
    for _, known, asked, names in bm25.term_blocks(terms, block_terms):
        rows = texts.mapInArrow(searching(asked, known, k, lambda p: np.ones(len(p.key))), f"number long, position {texts.schema['position'].dataType.simpleString()}, score double")
        found.append(rows.join(names, "number").select("query_id", "position", (F.col("score") / F.col("n")).alias("score")))
    return top_k(reduce(DataFrame.unionByName, found), k, F.col("position")).select("query_id", "rank", "position", "score")


def _named(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    named = ranked.join(corpus.select("position", "chunk_id"), "position") if "chunk_id" in corpus.columns else ranked.withColumn("chunk_id", F.col("position").cast("string"))
    return named.select("query_id", "rank", "position", "chunk_id", "score")


def fuse(rankings: list[DataFrame], rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: ``(query_id, chunk_id, position, score)``; a list adds nothing for what it lacks."""
    one = reduce(DataFrame.unionByName, [r.select("query_id", "chunk_id", "position", "rank") for r in rankings])
    return one.groupBy("query_id", "chunk_id", "position").agg(F.sum(F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("score"))


def hybrid(corpus: DataFrame, queries: DataFrame, k: int, settings: RetrievalSettings = RetrievalSettings("hybrid_rrf"), stored: StoredRanking | None = None) -> DataFrame:
    """Dense and lexical lists, each cut to the window, fused; ties go by chunk id."""
    window = settings.window(k)
    words = stored(queries, window) if stored else lexical(corpus, queries, window)
    fused = fuse([dense(corpus, queries, window), words], settings.rrf_k)
    return top_k(fused, k, F.col("chunk_id")).select("query_id", "rank", "position", "chunk_id", "score")


def rerank_candidates(candidates: DataFrame, queries: DataFrame, k: int, strategy: str = "hybrid_rrf", rrf_k: int = 60) -> DataFrame:
    """Second ranking of a store's candidates ``(query_id, rank, position, chunk_id, searchable)``.

    BM25 statistics come from the candidates alone.  ``lexical`` takes that
    order; ``hybrid_rrf`` fuses it with the order in which the store returned them.
    """
    scored = bm25.candidate_scores(candidates.select("query_id", "position", F.col("searchable").alias("text")), queries)
    named = scored.join(candidates.select("query_id", "position", "chunk_id", F.col("rank").alias("given")), ["query_id", "position"])
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "given")
    lex = named.where("score > 0").withColumn("rank", F.row_number().over(order))
    if strategy == "lexical":
        return lex.where(F.col("rank") <= k).select("query_id", "rank", "position", "chunk_id", "score")
    fused = fuse([candidates.select("query_id", "chunk_id", "position", "rank"), lex], rrf_k)
    return top_k(fused, k, F.col("chunk_id")).select("query_id", "rank", "position", "chunk_id", "score")


def rank(corpus: DataFrame, queries: DataFrame, k: int, settings: RetrievalSettings = RetrievalSettings(), stored: StoredRanking | None = None) -> DataFrame:
    """Rank by the strategy of the settings; ``k`` below 1 returns nothing.  ``stored`` ranks by BM25 where postings are kept."""
    if k <= 0:
        kind = queries.schema["query_id"].dataType.simpleString()
        return corpus.sparkSession.createDataFrame([], f"query_id {kind}, rank int, position {corpus.schema['position'].dataType.simpleString()}, chunk_id string, score double")
    if settings.strategy == "dense":
        return dense(corpus, queries, k)
    if settings.strategy == "blended":
        return blended(corpus, queries, k)
    if settings.strategy == "lexical":
        return stored(queries, k) if stored else lexical(corpus, queries, k)
    return hybrid(corpus, queries, k, settings, stored)
