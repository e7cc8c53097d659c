"""Evaluation metrics over arrays; an empty expectation scores 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _share(expected: Column, met: Column) -> Column:
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.size(met) / F.size(expected))


def _holds(text: Column, keyword: Column) -> Column:
    return F.contains(F.lower(text), F.lower(keyword))


def keyword_rate(answer: Column, keywords: Column) -> Column:
    """Share of keywords that the answer contains, whatever their case."""
    return _share(keywords, F.filter(keywords, lambda k: _holds(answer, k)))


def evidence_rate(texts: Column, keywords: Column) -> Column:
    """Share of keywords that some one text contains in full."""
    return _share(keywords, F.filter(keywords, lambda k: F.exists(texts, lambda t: _holds(t, k))))


def reciprocal_rank(texts: Column, keywords: Column) -> Column:
    """Mean over keywords of 1 / place of the first text that contains it."""
    def place(k: Column) -> Column:
        return F.array_position(F.transform(texts, lambda t: _holds(t, k)), F.lit(True))

    ranks = F.transform(keywords, lambda k: F.when(place(k) > 0, F.lit(1.0) / place(k)).otherwise(F.lit(0.0)))
    return F.when(F.size(keywords) == 0, F.lit(1.0)).otherwise(F.aggregate(ranks, F.lit(0.0), lambda s, x: s + x) / F.size(keywords))


def precision(texts: Column, keywords: Column) -> Column:
    """Share of texts that contain some keyword; no texts score 0."""
    relevant = F.filter(texts, lambda t: F.exists(keywords, lambda k: _holds(t, k)))
    return F.when(F.size(keywords) == 0, F.lit(1.0)).when(F.size(texts) == 0, F.lit(0.0)).otherwise(F.size(relevant) / F.size(texts))


def source_rate(sources: Column, expected: Column) -> Column:
    """Share of expected sources that are among the sources."""
    return _share(expected, F.filter(expected, lambda s: F.array_contains(sources, s)))


def failure_reasons(retrieved_source: Column, retrieved_span: Column, rank: Column, answer: Column, cited_source: Column, cited_span: Column) -> Column:
    """Names of what went wrong, in fixed order."""
    rules = [
        (retrieved_source < 1.0, "retrieval_missed_expected_source"),
        (retrieved_span < 1.0, "retrieval_missed_expected_span"),
        ((retrieved_span >= 1.0) & (rank < 1.0), "retrieval_ranked_expected_span_below_first"),
        (answer < 1.0, "answer_missing_expected_keywords"),
        (cited_source < 1.0, "citation_missed_expected_source"),
        (cited_span < 1.0, "citation_missed_expected_span"),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in rules]), lambda x: x.isNotNull())
