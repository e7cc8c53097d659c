"""Evaluation of answers against gold cases, summaries and degradation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import metrics as M
from corvane.operators import answers

RATES = ("answer_keyword_hit_rate", "retrieval_source_hit_rate", "retrieval_span_hit_rate", "retrieval_reciprocal_rank", "retrieval_precision", "citation_source_hit_rate", "citation_span_hit_rate")


def evaluate(cases: DataFrame, answered: DataFrame) -> DataFrame:
    """Rates and failure reasons per case.

    ``cases``: query_id and the arrays expected_answer_keywords,
    expected_source_paths, expected_span_keywords, expected_retrieval_keywords.
    ``answered``: query_id, answer, hits (array in rank order).
    """
    none = F.expr("CAST(array() AS array<string>)")
    rows = cases.join(answered, "query_id", "left")
    texts = F.coalesce(F.transform("hits", lambda h: h["text"]), none)
    sources = F.coalesce(answers.citations(F.col("hits")), none)
    rows = rows.select(*cases.columns, F.coalesce("answer", F.lit("")).alias("answer"), texts.alias("texts"), sources.alias("sources"))
    rows = rows.select(
        *cases.columns, "answer", "sources",
        M.keyword_rate(F.col("answer"), F.col("expected_answer_keywords")).alias("answer_keyword_hit_rate"),
        M.source_rate(F.col("sources"), F.col("expected_source_paths")).alias("retrieval_source_hit_rate"),
        M.evidence_rate(F.col("texts"), F.col("expected_retrieval_keywords")).alias("retrieval_span_hit_rate"),
        M.reciprocal_rank(F.col("texts"), F.col("expected_retrieval_keywords")).alias("retrieval_reciprocal_rank"),
        M.precision(F.col("texts"), F.col("expected_retrieval_keywords")).alias("retrieval_precision"),
        M.source_rate(F.col("sources"), F.col("expected_source_paths")).alias("citation_source_hit_rate"),
        M.evidence_rate(F.col("texts"), F.col("expected_span_keywords")).alias("citation_span_hit_rate"),
    )
    reasons = M.failure_reasons(*[F.col(c) for c in ("retrieval_source_hit_rate", "retrieval_span_hit_rate", "retrieval_reciprocal_rank", "answer_keyword_hit_rate", "citation_source_hit_rate", "citation_span_hit_rate")])
    return rows.withColumn("failure_reasons", reasons)


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Number of cases and mean rates at four decimals; 0 without cases.  Old names of three rates stay as aliases."""
    means = [F.coalesce(F.round(F.avg(r), 4), F.lit(0.0)).alias(r) for r in RATES]
    timed = [F.coalesce(F.round(F.avg("response_time_ms"), 2), F.lit(0.0)).alias("avg_response_time_ms")] if "response_time_ms" in results.columns else []
    out = results.groupBy(*by).agg(F.count("*").alias("num_cases"), *means, *timed)
    return out.withColumns({"avg_keyword_hit_rate": F.col("answer_keyword_hit_rate"), "source_hit_rate": F.col("citation_source_hit_rate"), "avg_citation_span_hit_rate": F.col("citation_span_hit_rate")})


def degradation(cases: DataFrame) -> DataFrame:
    """Why a cell may not enter the leaderboard: ``(cell, reason)``, null where nothing is wrong.

    ``cases``: cell, nth, has_diagnostics, requested_runtime, actual_runtime,
    chat_mode, embedding_mode, reranker_mode, reranker_reason.
    """
    def mode(column: str, name: str):
        return F.when(F.col(column) == "fallback", f"{name}_fallback").when(F.col(column) != "live", f"{name}_not_live")

    idle = (F.col("reranker_mode") == "ready") & F.col("reranker_reason").eqNullSafe("reranker_disabled")
    found = F.array(
        F.when(F.col("requested_runtime") != F.col("actual_runtime"), F.lit("runtime_fallback")),
        mode("chat_mode", "chat"), mode("embedding_mode", "embedding"), F.when(~idle, mode("reranker_mode", "reranker")),
    )
    each = cases.select("cell", "nth", "has_diagnostics", F.filter(found, lambda x: x.isNotNull()).alias("found"))
    # Few names exist, so the first case of each is enough.
    named = each.select("cell", "nth", "has_diagnostics", F.posexplode_outer("found").alias("place", "name")).groupBy("cell", "name").agg(F.min(F.struct("nth", "place")).alias("at"), F.min("has_diagnostics").alias("all_known"))
    out = named.groupBy("cell").agg(F.min("all_known").alias("all_known"), F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("at", "name")))).alias("names"))
    text = F.array_join(F.transform("names", lambda x: x["name"]), ",")
    return out.select("cell", F.when(~F.col("all_known"), "missing_diagnostics").when(text != "", text).alias("reason"))


def leaderboard(runs: DataFrame) -> DataFrame:
    """Finished cells by reciprocal rank, precision, answer rate and citation rate, then by time and run order."""
    ok = runs.where("status = 'ok'")
    return ok.orderBy(F.desc("retrieval_reciprocal_rank"), F.desc("retrieval_precision"), F.desc("answer_keyword_hit_rate"), F.desc("citation_span_hit_rate"), F.asc("avg_response_time_ms"), F.asc("run_no"))
