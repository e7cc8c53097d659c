"""Retrieval and answering of a set of questions as one plan."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Settings, as_payload, check_question
from corvane.errors import ConfigurationError
from corvane.operators import answers, chat, evaluation, ranking, rerank
from corvane.operators.bm25 import searchable_text
from corvane.operators.chat import ChatProvider
from corvane.operators.embedding import EmbeddingProvider, embed
from corvane.operators.index import ingest, needs_ingest
from corvane.operators.store import ParquetStore, side
from corvane.sources.corpus import list_documents, read_documents
from corvane.sources.shared import scratch, staged

#: One document in so many is scored ahead of all, for what the best chunks score at least.
FIRST = 8


def corpus_of(chunks: DataFrame) -> DataFrame:
    """Chunks as a corpus for ranking, with positions that rise with path and chunk number.

    Chunks are written once, where they are made.  A position is a key that is
    put together when read and compares as bytes: the path, the chunk number
    and the row in the written table, which keeps equal paths apart.  So no
    text is shuffled or written again for the sake of an order.  What is
    searched is put together when read too, as it holds the text once more.
    """
    plain = [c for c in chunks.columns if c != "embedding"]
    vector = [F.col("embedding").alias("vector")] if "embedding" in chunks.columns else []
    written = staged(chunks.select(F.monotonically_increasing_id().alias("row"), *plain, *vector), "corpus")
    return _placed(written, plain, F.lpad(F.lower(F.hex("row")), 16, "0"), *written.columns[len(plain) + 1 :])


def passing_corpus(chunks: DataFrame) -> DataFrame:
    """Chunks as a corpus for ranking that is written nowhere: each pass makes them again from their documents.

    A position ends in a digest of the chunk where :func:`corpus_of` has the
    row, so it is the same in every pass; only equal chunks of equal paths share one.
    """
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("start_char", "end_char", "metadata.heading_level", "metadata.section_title", "title", "text")]
    return _placed(chunks, chunks.columns, F.substring(F.sha2(F.concat_ws("\0", *own).cast("binary"), 256), 1, 32))


def part_of(rows: DataFrame) -> DataFrame:
    """What comes from one source path in ``FIRST``, of documents or chunks."""
    return rows.where(F.pmod(F.xxhash64("source_path"), F.lit(FIRST)) == 0)


def _placed(chunks: DataFrame, plain: list[str], last: Column, *more: str) -> DataFrame:
    """Chunks with a position, which ends in ``last``, and what is searched."""
    section, source = F.col("metadata.section_title"), F.col("metadata.source_title")
    return chunks.select(
        F.concat_ws("\0", "source_path", F.lpad(F.lower(F.hex("chunk_index")), 8, "0"), last).alias("position"), *plain,
        searchable_text(F.col("title"), section, F.col("text")).alias("searchable"), F.concat_ws(" ", "title", section, source).alias("metadata_text"), *more,
    )


def with_chunks(ranked: DataFrame, corpus: DataFrame) -> DataFrame:
    """``ranked (query_id, rank, position, score)`` with the chunks at its positions, by one pass over the corpus.

    Hashes of the positions go to all tasks, eight bytes each, so only chunks
    that were ranked leave them.  Those that share a position are equal, and one serves for all.
    """
    at, n = F.xxhash64("position"), ranked.count()
    wanted = F.broadcast(ranked.select(at.alias("at")).distinct())
    found = corpus.drop("searchable", "metadata_text").withColumn("at", at).join(wanted, "at", "left_semi").drop("at").dropDuplicates(["position"])
    return found.join(side(ranked, n), "position")


def retrieve(corpus: DataFrame, questions: DataFrame, settings: Settings, k: int | None = None, ask: Callable[[Column], Column] | None = None, reranker: ChatProvider | None = None, stored: ranking.StoredRanking | None = None) -> DataFrame:
    """Two-stage retrieval: hits with their chunks for every question ``(query_id, text, vector)``.

    A reranker is a chat provider, or a column function of the prompt;
    ``stored`` ranks by stored postings in place of the corpus' texts.
    """
    k = settings.top_k if k is None else k
    depth = k if settings.reranker == "none" else max(settings.rerank_candidate_k, k)
    ranked = ranking.rank(corpus, questions, depth if k > 0 else 0, settings.retrieval, stored)
    hits = ranked.drop("chunk_id").join(corpus.drop("vector", "searchable", "metadata_text"), "position")
    if settings.reranker == "none":
        return rerank.identity(hits, k)
    return rerank.model_rerank(hits, k, ask) if reranker is None else rerank.provider_rerank(hits, k, reranker)


def answer(questions: DataFrame, hits: DataFrame, reason: str = "missing_api_key", provider: ChatProvider | None = None) -> DataFrame:
    """``(query_id, question, hits, context, answer, citations, citation_spans)`` and modes and reasons of chat and reranker.

    A provider answers where it can; all other answers are extractive and name
    the reason.
    """
    second = ("rerank_mode", "rerank_reason")
    if second[0] in hits.columns:
        questions = questions.join(hits.groupBy("query_id").agg(*[F.max(c).alias(c) for c in second]), "query_id", "left")
    else:
        questions = questions.withColumns({c: F.lit(None).cast("string") for c in second})
    grouped = questions.select("query_id", F.col("text").alias("question"), *second).join(answers.ordered(hits), "query_id", "left")
    none = F.lit(None)
    rows = grouped.withColumn("hits", F.when(F.col("hits").isNull(), F.filter(F.coalesce("hits", none), lambda h: F.lit(False))).otherwise(F.col("hits")))
    rows = rows.withColumn("context", F.coalesce(answers.answer_context(F.col("hits")), F.lit(answers.NO_EVIDENCE)))
    if provider is None:
        rows = rows.withColumn("reply", F.lit(None).cast("string")).withColumn("failed", F.lit(reason))
    else:
        asked = chat.asked(rows.select("query_id", chat.prompt(F.col("question"), F.col("context")).alias("prompt")), provider)
        rows = rows.join(asked, "query_id", "left")
    return rows.select(
        "query_id", "question", "hits", "context", F.coalesce("reply", answers.extractive_answer(F.col("question"), F.col("context"), F.col("failed"))).alias("answer"),
        F.coalesce(answers.citations(F.col("hits")), F.array().cast("array<string>")).alias("citations"), answers.citation_spans(F.col("hits")).alias("citation_spans"),
        F.when(F.col("reply").isNull(), "fallback").otherwise("live").alias("chat_mode"), F.when(F.col("reply").isNull(), F.col("failed")).alias("chat_reason"), *second,
    )


def missing(key: str) -> str:
    """Why there is no provider: no key, or a key without an installed provider."""
    return "provider_not_installed" if key else "missing_api_key"


def basic_runtime(engine: Engine, questions: DataFrame) -> DataFrame:
    """Search once, then answer."""
    return answer(questions, engine.search(questions), missing(engine.settings.chat_key), engine.chat)


#: Runtimes by name; one that is not here is served by the basic one, which says so.
RUNNERS: dict[str, Callable[[Engine, DataFrame], DataFrame]] = {"basic": basic_runtime}


def dispatch(name: str) -> tuple[str, Callable[[Engine, DataFrame], DataFrame], str | None]:
    """``(runtime that serves, its function, reason)`` for a requested runtime."""
    return (name, RUNNERS[name], None) if name in RUNNERS else ("basic", basic_runtime, "runtime_not_installed")


@dataclass
class Engine:
    """The API: ingest, ask, evaluate, list documents, search, clock, health and information.

    Without providers the engine works offline and says so in its diagnostics.
    """

    spark: SparkSession
    settings: Settings
    chat: ChatProvider | None = None
    embedder: EmbeddingProvider | None = None
    reranker: ChatProvider | None = None
    embedding_status: dict = field(default_factory=dict, init=False)

    @classmethod
    def from_settings(cls, spark: SparkSession, settings: Settings) -> Engine:
        """With the providers that the settings name as ``module:Class``; each is made from the settings."""
        made = {name: load_provider(getattr(settings, f"{name}_provider"), settings) for name in ("chat", "embedding", "rerank")}
        return cls(spark, settings, made["chat"], made["embedding"], made["rerank"] or made["chat"])

    @property
    def store(self) -> ParquetStore:
        return ParquetStore(self.settings.index_path)

    def documents(self) -> list[str]:
        return [p.as_posix() for p in list_documents(self.settings.docs_dir, self.settings.exclude)]

    def health(self) -> dict:
        return {"status": "ok", "index": self.store.exists()}

    def info(self) -> dict:
        return {"settings": as_payload(self.settings), "documents": len(self.documents())}

    def now(self) -> str:
        """The present time in UTC."""
        return datetime.now(UTC).isoformat()

    def ingest(self) -> dict:
        return ingest(self.spark, self.settings, read_documents(self.spark, self.settings.docs_dir, self.settings.exclude), self.store, self.embedder)

    def ensure(self) -> None:
        if needs_ingest(self.settings, self.store, self.embedder):
            self.ingest()

    def corpus(self) -> DataFrame:
        return self.store.corpus(self.spark)

    def embedded(self, questions: DataFrame) -> tuple[DataFrame, dict]:
        """``questions (query_id, text)`` with ``vector``, and the embedding status."""
        s = self.settings
        made, status = embed(questions, self.embedder, s.embedding_batch, s.embedding_retries, s.embedding_backoff_ms)
        if self.embedder is None:
            status["reason"] = missing(s.embedding_key)
        return made.withColumnRenamed("embedding", "vector"), status

    def search(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """Hits of ``questions (query_id, text)``."""
        self.ensure()
        made, self.embedding_status = self.embedded(questions)
        store = self.store
        version = store.version()
        return retrieve(store.corpus(self.spark, version), made, self.settings, k, reranker=self.reranker, stored=lambda asked, depth: store.lexical(asked, depth, version))

    def ask_all(self, questions: DataFrame) -> DataFrame:
        return dispatch(self.settings.runtime)[1](self, questions)

    def ask(self, question: str) -> dict:
        """One question, answered as a plan of one row."""
        rows = self.spark.createDataFrame([(0, check_question(question))], "query_id long, text string")
        with scratch(self.spark):
            found = self.ask_all(rows).first()
        served, _, reason = dispatch(self.settings.runtime)
        status = lambda part: {"mode": part["mode"], "reason": part["reason"]}
        if self.settings.reranker == "none":
            second = {"mode": "ready", "reason": "reranker_disabled"}
        else:
            second = {"mode": found.rerank_mode or "ready", "reason": found.rerank_reason or (None if found.rerank_mode == "live" else "rerank_not_needed")}
        return {
            "question": found.question, "answer": found.answer, "citations": list(found.citations), "citation_spans": [r.asDict() for r in found.citation_spans or []],
            "diagnostics": {
                "requested_runtime": self.settings.runtime, "actual_runtime": served, "runtime_reason": reason, "vector_backend": self.settings.backend,
                "chat": {"mode": found.chat_mode, "reason": found.chat_reason}, "embedding": status(self.embedding_status), "reranker": second,
            },
        }

    def evaluate(self, cases: DataFrame) -> tuple[DataFrame, dict]:
        """Results per case of ``cases (query_id, question, ...)`` and their summary."""
        began = time.perf_counter()
        with scratch(self.spark):
            answered = self.ask_all(cases.select("query_id", F.col("question").alias("text")))
            results = staged(evaluation.evaluate(cases, answered.select("query_id", "answer", "hits")), "results", lasting=True)
        n = max(results.count(), 1)
        spent = round((time.perf_counter() - began) * 1000 / n, 2)
        totals = evaluation.summary(results.withColumn("response_time_ms", F.lit(spent))).first()
        return results, totals.asDict() if totals else {"num_cases": 0}


def load_provider(name: str, settings: Settings):
    """The provider named ``module:Class``, made from the settings; None for no name."""
    if not name:
        return None
    module, _, kind = name.partition(":")
    try:
        return getattr(import_module(module), kind)(settings)
    except (ImportError, AttributeError) as error:
        raise ConfigurationError(f"no provider {name!r}: {error}") from None


def require_live(diagnostics: dict) -> bool:
    """Whether chat and embedding really ran live."""
    return all(diagnostics[part]["mode"] == "live" for part in ("chat", "embedding"))
