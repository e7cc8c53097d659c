"""Second-stage reranking: none, or by the replies of a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

PREVIEW = 600


def identity(hits: DataFrame, k: int | Column) -> DataFrame:
    """The first ``k`` hits of each query; no other work."""
    return hits.where(F.col("rank") <= k)


def prompt(hits: DataFrame) -> DataFrame:
    """``(query_id, prompt)``: candidates numbered from 1 with title, path and a preview."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit(" ("), F.col("source_path"), F.lit(")\n"), T.one_line(F.col("text"), PREVIEW))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return listed.select("query_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("prompt"))


def apply_replies(hits: DataFrame, replies: DataFrame, k: int | Column) -> DataFrame:
    """Reorder ``hits (query_id, rank, score, ...)`` by ``replies (query_id, reply)``.

    ``k`` may be a column of the hits.  The first JSON array of a reply names candidates by number; repeated,
    foreign and other entries are dropped, and candidates it leaves out follow
    in their order.  Scores become 1 / rank.  A query without a usable reply
    keeps its order and scores.  ``rerank_mode`` and ``rerank_reason`` tell which.
    """
    sizes = hits.groupBy("query_id").agg(F.max("rank").alias("listed"))
    numbers = replies.join(sizes, "query_id").select("query_id", F.array_distinct(F.filter(F.coalesce(T.candidate_numbers(F.col("reply")), F.array().cast("array<int>")), lambda x: (x >= 1) & (x <= F.col("listed")))).alias("numbers"))
    usable = numbers.where(F.size("numbers") > 0)
    named = hits.join(usable, "query_id", "left")
    at = F.array_position("numbers", F.col("rank"))
    key = F.when(F.col("numbers").isNull(), F.col("rank").cast("long")).when(at > 0, at).otherwise(F.lit(1_000_000_000) + F.col("rank"))
    moved = named.withColumn("new_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(key))).where(F.col("new_rank") <= k)
    live = F.col("numbers").isNotNull()
    return (
        moved.withColumn("score", F.when(live, F.lit(1.0) / F.col("new_rank")).otherwise(F.col("score")))
        .withColumn("rank", F.col("new_rank"))
        .withColumn("rerank_mode", F.when(live, "live").otherwise("fallback"))
        .withColumn("rerank_reason", F.when(~live, "unusable_rerank_output"))
        .drop("new_rank", "numbers")
    )


def model_rerank(hits: DataFrame, k: int | Column, ask: Callable[[Column], Column] | None) -> DataFrame:
    """Rerank with a model given as a column function of the prompt, or None where there is no key."""
    if ask is None:
        return identity(hits, k).withColumn("rerank_mode", F.lit("fallback")).withColumn("rerank_reason", F.lit("missing_api_key"))
    many = hits.join(hits.groupBy("query_id").agg(F.count("*").alias("listed")), "query_id")
    single = many.where("listed = 1").drop("listed").withColumn("rerank_mode", F.lit("ready")).withColumn("rerank_reason", F.lit("rerank_not_needed"))
    several = many.where("listed > 1").drop("listed")
    replies = prompt(several).select("query_id", ask(F.col("prompt")).alias("reply"))
    return apply_replies(several, replies, k).unionByName(single)


def provider_rerank(hits: DataFrame, k: int | Column, provider) -> DataFrame:
    """:func:`model_rerank` by a chat provider; where it fails a query keeps its order and says why."""
    from corvane.operators.chat import asked

    several = hits.join(hits.groupBy("query_id").agg(F.count("*").alias("listed")).where("listed > 1"), "query_id", "left_semi")
    replies = asked(prompt(several), provider)
    ranked = apply_replies(several, replies.select("query_id", "reply"), k).join(replies.select("query_id", "failed"), "query_id", "left")
    ranked = ranked.withColumn("rerank_reason", F.coalesce("failed", "rerank_reason")).drop("failed")
    single = hits.join(several.select("query_id").distinct(), "query_id", "left_anti").where(F.col("rank") <= k)
    return ranked.unionByName(single.withColumn("rerank_mode", F.lit("ready")).withColumn("rerank_reason", F.lit("rerank_not_needed")))
