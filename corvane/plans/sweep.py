"""Configuration sweeps: the grid of settings, its cells, and the leaderboard.

All cells are one plan.  Cells that share chunk settings share an index, whose
rows are scanned once for the dense and the blended ranking and once for the
lexical one, each as deep as any cell needs it.  A cell then cuts these rankings
or fuses them, so cells are rows of a small frame that is joined to the ranked
hits, and answers, rates, diagnostics and means are grouped by cell.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import BACKENDS, CHUNK_STRATEGIES, MATRIX_CAP, RERANKERS, RETRIEVAL_STRATEGIES, RUNTIMES, Settings
from corvane.errors import ConfigurationError, StoreError
from corvane.functions.canonical import identity
from corvane.operators import evaluation, ranking, rerank
from corvane.operators.chat import ChatProvider
from corvane.operators.chunking import chunk_documents
from corvane.operators.embedding import EmbeddingProvider, embed
from corvane.operators.store import side
from corvane.plans.engine import answer, corpus_of, dispatch, missing, part_of
from corvane.sources.shared import discard, scratch, staged

# Axis, setting, label prefix, choices, and whether it is swept unasked.
AXES = (
    ("runtimes", "runtime", "", RUNTIMES, False),
    ("vector_backends", "backend", "", BACKENDS, False),
    ("chunk_strategies", "chunk_strategy", "", CHUNK_STRATEGIES, True),
    ("retrieval_strategies", "retrieval_strategy", "", RETRIEVAL_STRATEGIES, True),
    ("rerankers", "reranker", "rr-", RERANKERS, False),
    ("top_ks", "top_k", "k", None, False),
    ("chunk_sizes", "chunk_size", "s", None, False),
    ("chunk_overlaps", "chunk_overlap", "o", None, False),
)


#: Version of the identity of a cell's settings.
CONFIGURATION = "configuration-1"


def label(settings: Settings) -> str:
    """One part per axis, so cells that differ have different labels."""
    return ":".join(f"{prefix}{getattr(settings, name)}" for _, name, prefix, _, _ in AXES)


def cells(settings: Settings, asked: Mapping[str, Sequence | None] | None = None) -> list[Settings]:
    """All combinations of the asked values, in axis order; the number is checked before any is made."""
    asked = asked or {}
    values = []
    for axis, name, _, choices, swept in AXES:
        given = asked.get(axis)
        one = list(given) if given is not None else list(choices) if swept else [getattr(settings, name)]
        if not one:
            raise ConfigurationError(f"{axis} must not be empty")
        values.append(list(dict.fromkeys(one)))
    total = 1
    for v in values:
        total *= len(v)
    if total > MATRIX_CAP:
        raise ConfigurationError(f"{total} cells are more than {MATRIX_CAP}")
    return [settings.with_(**dict(zip((a[1] for a in AXES), combination))) for combination in product(*values)]


#: Settings that can change what a cell measures; no keys, addresses or paths.
MEASURED = (
    "runtime", "backend", "chunk_strategy", "chunk_size", "chunk_overlap", "top_k", "retrieval_strategy", "candidate_k", "rrf_k", "reranker", "rerank_candidate_k", "agent_max_turns",
    "chat_model", "chat_provider", "embedding_model", "embedding_provider", "embedding_batch", "embedding_retries", "embedding_backoff_ms", "rerank_provider",
)


def configurations(spark: SparkSession, planned: Sequence[tuple[int, Settings]]) -> DataFrame:
    """``(run_no, label, configuration)``: a row per cell, its measured settings as a struct, and ``configuration_identity``."""
    schema = ", ".join(f"{name} {'string' if isinstance(getattr(planned[0][1], name), str) else 'long'}" for name in MEASURED)
    rows = [(no, label(cell), tuple(getattr(cell, name) for name in MEASURED)) for no, cell in planned]
    made = spark.createDataFrame(rows, f"run_no int, label string, configuration struct<{schema.replace(' ', ':').replace(',:', ',')}>")
    return made.withColumn("configuration_identity", identity(F.col("configuration"), made.schema["configuration"].dataType, CONFIGURATION))


def skip_reason(settings: Settings, remote_url: str | None = None, error: Exception | None = None) -> str | None:
    """Why a cell cannot run here: its store has no address, or could not be reached or loaded when it ran."""
    if settings.backend == "local":
        return None
    if not remote_url:
        return "missing_qdrant_url"
    code = error.code if isinstance(error, StoreError) else None
    return {"unreachable": "qdrant_unreachable", "dependency_missing": "missing_qdrant_client"}.get(code)


def _depth(cell: Settings) -> int:
    """How many hits a cell looks at before its second stage."""
    return cell.top_k if cell.reranker == "none" else max(cell.rerank_candidate_k, cell.top_k)


def _rankings(corpus: DataFrame, questions: DataFrame, own: Sequence[Settings]) -> tuple[DataFrame, DataFrame]:
    """All rankings that the cells of one index cut their hits from, and the chunks in them.

    ``(strategy, window, rrf_k, query_id, rank, position, score)`` and the rows
    of ``corpus`` without what is searched.  Both are written, so nothing reads
    the corpus after it.
    """
    depths: dict[str, int] = {}
    for cell in own:
        deep = cell.retrieval.window(_depth(cell)) if cell.retrieval_strategy == "hybrid_rrf" else _depth(cell)
        for ranker in ("dense", "lexical") if cell.retrieval_strategy == "hybrid_rrf" else (cell.retrieval_strategy,):
            depths[ranker] = max(deep, depths.get(ranker, 0))
    columns = ("query_id", "rank", "position", "score")
    spark = corpus.sparkSession
    # Rows that a scan writes go with it.
    with scratch(spark):
        parts, first = [], part_of(corpus)
        if scans := {r: k for r, k in depths.items() if r != "lexical"}:
            parts.append(ranking.scanned(corpus, questions, scans, part=first).select(F.col("ranker").alias("strategy"), *columns))
        if "lexical" in depths:
            parts.append(ranking.lexical(corpus.drop("chunk_id"), questions, depths["lexical"], first).select(F.lit("lexical").alias("strategy"), *columns))
        plain = staged(reduce(DataFrame.unionByName, parts), "sweep-rankings", lasting=True)
        ranked = staged(plain.select("position").distinct(), "sweep-positions")
        # A few rows a query and list: only these chunks are looked up.
        texts = staged(corpus.drop("vector", "searchable", "metadata_text").join(side(ranked, ranked.count()), "position"), "sweep-texts", lasting=True)
    none = F.lit(None).cast("int")
    out = [plain.select("strategy", none.alias("window"), none.alias("rrf_k"), *columns)]
    chunk_ids = texts.select("position", "chunk_id")
    fused = {(c.retrieval.window(_depth(c)), c.rrf_k, _depth(c)) for c in own if c.retrieval_strategy == "hybrid_rrf"}
    for window, rrf_k in sorted({f[:2] for f in fused}):
        lists = plain.where(F.col("strategy").isin("dense", "lexical") & (F.col("rank") <= window)).join(chunk_ids, "position")
        both = [lists.where(F.col("strategy") == r) for r in ("dense", "lexical")]
        deep = max(d for w, r, d in fused if (w, r) == (window, rrf_k))
        best = ranking.top_k(ranking.fuse(both, rrf_k), deep, F.col("chunk_id"))
        out.append(best.select(F.lit("hybrid_rrf").alias("strategy"), F.lit(window).alias("window"), F.lit(rrf_k).alias("rrf_k"), *columns))
    return reduce(DataFrame.unionByName, out), texts


def evaluate_cells(planned: Sequence[tuple[int, Settings]], documents: DataFrame, cases: DataFrame, chat: ChatProvider | None = None, embedder: EmbeddingProvider | None = None, reranker: ChatProvider | None = None) -> DataFrame:
    """``(run_no, num_cases, rates ..., reason)``: the means of every cell, and why it is no live run (null for none).

    ``planned`` has (run_no, settings) of at most ``MATRIX_CAP`` cells;
    ``documents (source_path, text)``, ``cases (query_id, question, ...)``.
    Without cases there are no rows.
    """
    spark = documents.sparkSession
    settings = planned[0][1]
    vectors = embedder is not None or any(c.retrieval_strategy != "lexical" for _, c in planned)
    questions = cases.select("query_id", F.col("question").alias("text"))
    options = (settings.embedding_batch, settings.embedding_retries, settings.embedding_backoff_ms)
    modes = {"questions": "fallback"}
    if vectors:
        made, status = embed(questions, embedder, *options)
        questions, modes["questions"] = staged(made.withColumnRenamed("embedding", "vector"), "questions"), status["mode"]

    indexes: dict[tuple, list[tuple[int, Settings]]] = {}
    for run_no, cell in planned:
        indexes.setdefault((cell.chunk_strategy, cell.chunk_size, cell.chunk_overlap), []).append((run_no, cell))
    found, texts, rows = [], [], []
    for number, (key, own) in enumerate(indexes.items()):
        chunks = chunk_documents(documents, *key)
        if vectors:
            chunks, status = embed(chunks, embedder, *options) if embedder else (chunks, {"mode": "fallback"})
            modes[number] = status["mode"]
        corpus = corpus_of(chunks)
        # Hash vectors are worked out by the scan: 128 numbers a chunk take longer to write and read, and as much disk as the texts.
        rankings, hits_of = _rankings(corpus, questions, [c for _, c in own])
        discard(spark, corpus)
        found.append(rankings.withColumn("index", F.lit(number)))
        texts.append(hits_of.withColumn("index", F.lit(number)))
        embedding = "live" if vectors and {modes["questions"], modes[number]} == {"live"} else "fallback"
        for run_no, c in own:
            fused = c.retrieval_strategy == "hybrid_rrf"
            rows.append((run_no, number, c.retrieval_strategy, c.retrieval.window(_depth(c)) if fused else None, c.rrf_k if fused else None, _depth(c), c.top_k, c.reranker, c.runtime, dispatch(c.runtime)[0], embedding))
    # At most MATRIX_CAP rows.
    cells_of = F.broadcast(spark.createDataFrame(rows, "run_no int, index int, strategy string, window int, rrf_k int, depth int, top_k int, reranker string, requested_runtime string, actual_runtime string, embedding_mode string"))

    lists = reduce(DataFrame.unionByName, found).alias("l").join(
        cells_of.alias("c"),
        (F.col("l.index") == F.col("c.index")) & (F.col("l.strategy") == F.col("c.strategy")) & F.col("l.window").eqNullSafe(F.col("c.window")) & F.col("l.rrf_k").eqNullSafe(F.col("c.rrf_k")) & (F.col("l.rank") <= F.col("c.depth")),
    )
    # A case of a cell is a question of its own from here on.
    own_id = F.struct("run_no", F.col("query_id").alias("case_id"))
    lists = staged(lists.select("c.run_no", "l.index", "c.top_k", "c.reranker", "l.query_id", "l.rank", "l.position", "l.score"), "sweep-lists")
    hits = reduce(DataFrame.unionByName, texts).join(side(lists, lists.count()), ["index", "position"]).withColumn("query_id", own_id)
    hits = staged(hits, "sweep-hits")

    plain = hits.where("reranker = 'none'").where("rank <= top_k").withColumns({"rerank_mode": F.lit("ready"), "rerank_reason": F.lit("reranker_disabled")})
    second = hits.where("reranker <> 'none'")
    if any(c.reranker != "none" for _, c in planned):
        again = rerank.model_rerank(second, F.col("top_k"), None) if reranker is None else rerank.provider_rerank(second, F.col("top_k"), reranker)
        plain = plain.unionByName(again.select(*plain.columns))
    asked = cases.withColumn("run_no", F.explode(F.array(*[F.lit(n).cast("int") for n, _ in planned]))).withColumn("query_id", own_id)
    answered = staged(answer(asked.select("query_id", F.col("question").alias("text")), plain, missing(settings.chat_key), chat), "sweep-answers")
    results = evaluation.evaluate(asked.drop("run_no"), answered.select("query_id", "answer", "hits")).withColumn("run_no", F.col("query_id.run_no"))
    means = evaluation.summary(results, "run_no")

    about = answered.join(cells_of, F.col("query_id.run_no") == F.col("run_no"))
    idle = F.when(F.col("reranker") == "none", "reranker_disabled").otherwise("rerank_not_needed")
    diagnosed = about.select(
        F.col("run_no").alias("cell"), F.col("query_id.case_id").alias("nth"), F.lit(True).alias("has_diagnostics"), "requested_runtime", "actual_runtime", "chat_mode", "embedding_mode",
        F.coalesce("rerank_mode", F.lit("ready")).alias("reranker_mode"), F.coalesce("rerank_reason", F.when(F.coalesce("rerank_mode", F.lit("ready")) == "ready", idle)).alias("reranker_reason"),
    )
    return means.join(evaluation.degradation(diagnosed).withColumnRenamed("cell", "run_no"), "run_no", "left")


def run(spark: SparkSession, settings: Settings, documents: DataFrame, cases: DataFrame, asked: Mapping[str, Sequence | None] | None = None, chat: ChatProvider | None = None, embedder: EmbeddingProvider | None = None, reranker: ChatProvider | None = None, remote_url: str | None = None) -> tuple[list[dict], list[dict]]:
    """Evaluate every cell over ``documents (source_path, text)``; returns the runs and the leaderboard.

    A cell is ``ok`` if every case ran live, else ``degraded`` with the
    reasons, and stays off the leaderboard then, as its numbers would not be
    those of a live run.  Where the joint plan fails, halves of the cells are
    tried apart until the failing ones stand alone as ``error``.  The time of a
    plan is shared alike by its cells and cases.
    """
    planned = list(enumerate(cells(settings, asked)))
    known = {r.run_no: r.configuration_identity for r in configurations(spark, planned).collect()}
    runs = {no: {"label": label(cell), "run_no": no, "configuration_identity": known[no], "status": "skipped", "reason": skip_reason(cell, remote_url), "summary": None} for no, cell in planned}

    def fill(part: list[tuple[int, Settings]]) -> None:
        began = time.perf_counter()
        try:
            for no, cell in part:
                if cell.backend != "local":
                    raise StoreError("no client of a remote store is installed", "dependency_missing")
            with scratch(spark):
                found = {r.run_no: r.asDict() for r in evaluate_cells(part, documents, cases, chat, embedder, reranker).collect()}
        except Exception as error:
            if len(part) > 1:
                fill(part[: len(part) // 2])
                fill(part[len(part) // 2 :])
                return
            no, cell = part[0]
            skipped = skip_reason(cell, remote_url, error)
            runs[no] |= {"status": "skipped", "reason": skipped} if skipped else {"status": "error", "reason": f"{type(error).__name__}: {error}"[:240]}
            return
        n = sum(r["num_cases"] for r in found.values())
        spent = round((time.perf_counter() - began) * 1000 / max(n, 1), 2)
        for no, _ in part:
            totals = found.get(no)
            reason = totals.pop("reason") if totals else "no_eval_cases"
            runs[no] |= {"status": "degraded" if reason else "ok", "reason": reason, "summary": {k: v for k, v in totals.items() if k != "run_no"} | {"avg_response_time_ms": spent} if totals else None}

    if todo := [(no, cell) for no, cell in planned if not runs[no]["reason"]]:
        with scratch(spark):
            cases = staged(cases, "sweep-cases")
            fill(todo)
    ordered = [runs[no] for no, _ in planned]
    return ordered, leaderboard(ordered)


def leaderboard(runs: list[dict]) -> list[dict]:
    """Finished cells, best first; equal ones keep their order."""
    ok = [r for r in runs if r["status"] == "ok" and isinstance(r.get("summary"), dict)]
    keys = ("retrieval_reciprocal_rank", "retrieval_precision", "answer_keyword_hit_rate", "citation_span_hit_rate")
    return sorted(({"label": r["label"], **r["summary"]} for r in ok), key=lambda s: (*(-float(s.get(k) or 0) for k in keys), float(s.get("avg_response_time_ms") or 0)))
