"""Contexts, citations and extractive answers from ranked hits.

``hits``: query_id, rank, score, chunk_id, source_path, title, text,
chunk_index, start_char, end_char.  Each function groups the few hits of a
query once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

# What a context and a result list say when they are empty.
NO_EVIDENCE = "No supporting documents were retrieved."
NO_RESULTS = "No relevant chunks were found."
_FIELDS = ("chunk_id", "source_path", "title", "text", "chunk_index", "start_char", "end_char", "score")


def ordered(hits: DataFrame) -> DataFrame:
    """``(query_id, hits)``: each query's hits as an array in rank order."""
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *_FIELDS))).alias("hits"))


def _blocks(hits: Column, fields: list[tuple[str, str]], body: str) -> Column:
    ids = F.array_distinct(F.transform(hits, lambda h: h["chunk_id"]))

    def block(h: Column) -> Column:
        value = {"score": lambda: F.format_string("%.4f", h["score"])}
        lines = [F.concat(F.lit(f"{label}: "), value.get(name, lambda n=name: h[n].cast("string"))()) for label, name in fields]
        head = F.concat(F.lit("[S"), F.array_position(ids, h["chunk_id"]).cast("string"), F.lit("]"))
        return F.concat_ws("\n", head, *lines, F.concat(F.lit(f"{body}: "), h["text"]))

    return F.array_join(F.transform(hits, block), "\n\n")


_PLACE = [("title", "title"), ("chunk_index", "chunk_index"), ("start_char", "start_char"), ("end_char", "end_char")]


def answer_context(hits: Column) -> Column:
    """Labelled evidence blocks for a chat model."""
    return F.when(F.size(hits) > 0, _blocks(hits, [("source", "source_path"), *_PLACE], "content")).otherwise(NO_EVIDENCE)


def tool_results(hits: Column) -> Column:
    """Labelled result blocks with scores, as a search tool returns them."""
    return F.when(F.size(hits) > 0, _blocks(hits, [("source_path", "source_path"), *_PLACE, ("score", "score")], "text")).otherwise(NO_RESULTS)


def citations(hits: Column) -> Column:
    """Distinct source paths in rank order."""
    return F.array_distinct(F.transform(hits, lambda h: h["source_path"]))


def citation_spans(hits: Column) -> Column:
    """Spans of the hits with their source ids."""
    ids = F.array_distinct(F.transform(hits, lambda h: h["chunk_id"]))
    return F.transform(
        hits,
        lambda h: F.struct(
            h["source_path"].alias("source_path"), h["chunk_id"].alias("chunk_id"), h["chunk_index"].alias("chunk_index"), h["start_char"].alias("start_char"), h["end_char"].alias("end_char"),
            h["text"].alias("text"), F.concat(F.lit("S"), F.array_position(ids, h["chunk_id"]).cast("string")).alias("source_id"),
        ),
    )


def merge_hits(hits: DataFrame) -> DataFrame:
    """Hits of several searches ``(query_id, search_no, rank, chunk_id, ...)``: the first sighting of each chunk stays."""
    first = Window.partitionBy("query_id", "chunk_id").orderBy("search_no", "rank")
    kept = hits.withColumn("sighting", F.row_number().over(first)).where("sighting = 1").drop("sighting")
    return kept.withColumn("source_no", F.row_number().over(Window.partitionBy("query_id").orderBy("search_no", "rank")))


def extractive_answer(question: Column, context: Column, reason: Column) -> Column:
    """The first two evidence bodies as an answer, or a sentence that there are none."""
    bodies = F.slice(F.filter(T.context_bodies(context), lambda b: b != ""), 1, 2)
    found = F.concat(F.lit("Provider fallback ("), F.coalesce(reason, F.lit("live_provider_unavailable")), F.lit("); extractive answer: "), F.array_join(bodies, " "))
    return F.when(F.size(bodies) > 0, found).otherwise(F.concat(F.lit("I could not find supporting context for: "), question))


def merged_status(statuses: DataFrame) -> DataFrame:
    """``(key, nth, provider, mode, reason)`` -> one status per key: the gravest mode, the distinct reasons in order."""
    grave = F.array_position(F.array(*map(F.lit, ("ready", "live", "unknown", "fallback"))), F.col("mode"))
    grouped = statuses.groupBy("key").agg(F.max_by("mode", F.struct(grave, "nth")).alias("mode"), F.max_by("provider", "nth").alias("provider"), F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("nth", "reason")))).alias("reasons"))
    text = F.array_join(F.array_distinct(F.transform("reasons", lambda r: r["reason"])), ";")
    return grouped.select("key", "provider", "mode", F.when(text != "", text).alias("reason"))
