"""BM25 with statistics of the whole corpus, or of each query's candidates.

The terms of a bounded block of queries go to all tasks.  :func:`best` reads
the documents twice, once for the frequencies of these terms and once for the
scores: a task keeps the k best rows of each query, so nothing of the size of
queries by documents, nor any posting, is written, shuffled or held.  Where a
part of the documents is given, it is scored first, and its k-th best scores
are floors for all tasks: rows below them leave no task, however many there are.
:func:`scores` returns every score above 0, which is a table of that size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.batches import Asked, Postings, Words, pieces, searching
from corvane.sources.shared import staged, writing

K1, B = 1.5, 0.75
BLOCK_TERMS = 1 << 20
#: Tasks for each core of a scan that keeps the best rows of every query and task.
TASKS = 4


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def few_tasks(rows: DataFrame) -> DataFrame:
    """``rows`` in a number of tasks that does not grow with them: what leaves a scan then grows with the queries alone, and floors stand for longer."""
    return rows.coalesce(TASKS * rows.sparkSession.sparkContext.defaultParallelism)


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """``(query_id, term, qtf)``: repeated terms of a query count."""
    return queries.select("query_id", F.explode(T.terms(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def exploded_terms(rows: DataFrame) -> DataFrame:
    """``rows (..., text)`` -> a row per term, with the number of terms of its text as ``length``.

    The number is taken before the explode, which would else evaluate it again
    for every term; the outer form keeps Spark from adding a filter that reads
    the terms once more.
    """
    keys = [c for c in rows.columns if c != "text"]
    counted = rows.withColumn("terms", T.terms(F.col("text"))).select(*keys, F.size("terms").alias("length"), "terms")
    return counted.select(*keys, "length", F.explode_outer("terms").alias("term")).where("term IS NOT NULL")


def corpus_statistics(corpus: DataFrame, text_col: str = "text") -> tuple[int, float]:
    """Number of documents and mean number of terms; documents without terms count."""
    n, average = corpus.agg(F.count("*"), F.avg(F.size(T.terms(F.col(text_col))))).first()
    return n, float(average or 0.0)


def searchable_text(title: Column, section: Column, text: Column) -> Column:
    """Title, section title and text, without the empty ones."""
    return F.concat_ws(" ", *[F.when(x != "", x) for x in (title, section, text)])


def scores(corpus: DataFrame, queries: DataFrame, text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``corpus (position, text)`` and ``queries (query_id, text)`` -> ``(query_id, position, score)`` above 0."""
    n, average = corpus_statistics(corpus, text_col)
    wanted = query_terms(queries)
    if average <= 0:
        return wanted.select("query_id", F.lit(0).cast("long").alias("position"), F.lit(0.0).alias("score")).limit(0)
    blocks = max(1, -(-wanted.count() // block_terms))
    parts = [_block_scores(corpus, wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k), n, average, text_col) for k in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _block_scores(corpus: DataFrame, wanted: DataFrame, n: int, average: float, text_col: str) -> DataFrame:
    read = exploded_terms(corpus.select("position", F.col(text_col).alias("text")))
    # One block of query terms: at most BLOCK_TERMS rows.
    of_query = read.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    # Written once: document frequencies and scores both read the postings.
    tf = staged(of_query.groupBy("position", "length", "term").agg(F.count("*").alias("tf")), "postings")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = wanted.join(df, "term").select("query_id", "term", (F.col("qtf") * idf(F.lit(n), F.col("df"))).alias("w"))
    # Grouping by query and document needs no shuffle where documents are dealt out by position.
    scored = tf.repartition("position").join(F.broadcast(weights), "term").withColumn("s", F.col("w") * term_weight(F.col("tf"), F.col("length"), F.lit(average)))
    return scored.groupBy("query_id", "position").agg(F.sum("s").alias("score")).where("score > 0")


def term_blocks(wanted: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[tuple[pa.Table, dict[bytes, int], Asked, DataFrame]]:
    """Blocks of ``wanted (query_id, term, ...)``: a bounded number of rows each, by query.

    Each as its rows, the known terms, the queries by term with weights of 1,
    and ``(number, query_id, n)``: what the numbers of queries stand for, with each query's rows.
    """
    wanted = staged(wanted, "query-terms")
    blocks = max(1, -(-wanted.count() // block_terms))
    for b in range(blocks):
        table = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        ids = table.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        known: dict[bytes, int] = {}
        term = np.array([known.setdefault(t.encode(), len(known)) for t in table.column("term").to_pylist()], np.int64)
        number = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.bincount(number, minlength=len(ids.dictionary))
        names = pa.table({"number": pa.array(np.arange(len(n))), "query_id": ids.dictionary, "n": pa.array(n)})
        yield table, known, Asked(number, term, np.ones(len(term)), len(n)), F.broadcast(wanted.sparkSession.createDataFrame(names, f"number long, query_id {wanted.schema['query_id'].dataType.simpleString()}, n long"))


def frequencies(corpus: DataFrame, known: dict[bytes, int]) -> tuple[int, float, np.ndarray]:
    """Of ``corpus (text)``: its number of rows, their mean number of terms, and how many have each known term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, length, words = np.zeros(len(known), np.int64), 0, 0, Words(known)
        for batch in batches:
            for piece in pieces(batch, 0):
                found = Postings(piece.column(0), words)
                df += np.diff(found.start)
                rows, length = rows + found.rows, length + int(found.length.sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[there, -1, -2]), pa.array(np.r_[df[there], rows, length])], ["term", "n"])

    # A row a known term and two more.
    with writing(corpus.sparkSession):
        summed = corpus.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    total = dict(zip(summed.column("term").to_pylist(), summed.column("n").to_pylist()))
    n = total.get(-1, 0)
    return n, total.get(-2, 0) / n if n else 0.0, np.array([total.get(x, 0) for x in range(len(known))], np.int64)


def floors(part: DataFrame, known: dict[bytes, int], asked: Asked, k: int, impact: Callable[[Postings], np.ndarray]) -> np.ndarray:
    """The ``k``-th best score of each query among the rows of ``part (position, text)``, 0 where it has fewer: the ``k``-th best of more rows is no lower."""
    spark, place = part.sparkSession, part.schema["position"].dataType.simpleString()
    # A task a core, as each sends k scores a query.
    rows = part.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(searching(asked, known, k, impact), f"number long, position {place}, score double")
    with writing(spark):
        kth = rows.groupBy("number").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k).select("number", F.element_at("s", k).alias("score")).toArrow()
    floor = np.zeros(asked.n)
    floor[kth.column("number").to_numpy()] = kth.column("score").to_numpy()
    return floor


def best(corpus: DataFrame, queries: DataFrame, k: int, text_col: str = "text", block_terms: int = BLOCK_TERMS, part: DataFrame | None = None) -> DataFrame:
    """``(query_id, position, score)`` above 0: of each task's rows the ``k`` best of every query, so the ``k`` best of all are among them.

    ``part`` is any part of the corpus, cheaper to read.  It is scored first,
    and tasks keep only rows that reach its ``k``-th best scores; all rows are
    searched, and the ``k`` best of all reach them too.
    """
    texts = few_tasks(corpus.select("position", F.col(text_col).alias("text")))
    found = []
    for table, known, asked, names in term_blocks(query_terms(queries), block_terms):
        n, average, df = frequencies(texts, known)
        asked = asked.weighed(table.column("qtf").to_numpy() * np.log(1 + (n - df + 0.5) / (df + 0.5))[asked.term])

        def impact(p: Postings, average: float = average) -> np.ndarray:
            tf = p.count.astype(float)
            return tf * (K1 + 1) / (tf + K1 * (1 - B + B * p.length[p.row] / average))

        floor = None if part is None or k < 1 else floors(part.select("position", F.col(text_col).alias("text")), known, asked, k, impact)
        rows = texts.mapInArrow(searching(asked, known, k, impact, floor), f"number long, position {texts.schema['position'].dataType.simpleString()}, score double")
        found.append(rows.join(names, "number").select("query_id", "position", "score"))
    return reduce(DataFrame.unionByName, found)


def candidate_scores(candidates: DataFrame, queries: DataFrame, text_col: str = "text") -> DataFrame:
    """BM25 where each query's own candidates are the corpus.

    ``candidates (query_id, position, text)`` -> ``(query_id, position,
    score)``, 0 where no term matches.  Candidate lists are short, so the
    statistics are plain groupings by query.
    """
    found = candidates.select("query_id", "position", T.terms(F.col(text_col)).alias("terms"))
    stats = found.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("average"))
    read = exploded_terms(candidates.select("query_id", "position", F.col(text_col).alias("text")))
    tf = read.groupBy("query_id", "position", "length", "term").agg(F.count("*").alias("tf"))
    tf = tf.join(query_terms(queries), ["query_id", "term"])
    df = tf.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    scored = tf.join(df, ["query_id", "term"]).join(stats, "query_id")
    scored = scored.withColumn("s", F.col("qtf") * idf(F.col("n"), F.col("df")) * term_weight(F.col("tf"), F.col("length"), F.col("average")))
    summed = scored.groupBy("query_id", "position").agg(F.sum("s").alias("score"))
    return found.select("query_id", "position").join(summed, ["query_id", "position"], "left").select("query_id", "position", F.coalesce("score", F.lit(0.0)).alias("score"))
