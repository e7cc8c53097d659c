"""The sweep: one plan for all cells, live and offline, against one engine a cell."""

import json

import pytest

from corvane.config import Settings
from corvane.operators import evaluation
from corvane.plans import sweep
from corvane.plans.engine import answer, corpus_of, retrieve
from corvane.sources import gold


class Live:
    """Chat, embedding and rerank provider without a network."""

    def complete(self, prompt):
        return "[2, 1]" if prompt.startswith("1. ") else "Dogs bark at night [S1]."

    def embed(self, texts):
        return [[float("dog" in t.lower()), float("cat" in t.lower()), 0.1] for t in texts]


class Silent(Live):
    def complete(self, prompt):
        return ""


DOCS = [("d/cats.md", "# Cats\nCats sleep all day.\n\n# Food\nCats eat fish."), ("d/dogs.md", "# Dogs\nDogs bark at night.\n\nDogs run."), ("d/blank.md", " ")]
CASES = [{"question": "when do dogs bark", "expected_answer_keywords": ["night"], "expected_source_paths": ["d/dogs.md"], "expected_span_keywords": ["bark"]}, {"question": "what do cats eat", "expected_span_keywords": ["fish"]}, {"question": "???"}]


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.createDataFrame(DOCS, "source_path string, text string")
    return docs, gold.gold_cases(spark.createDataFrame([(n, json.dumps(c)) for n, c in enumerate(CASES)], "query_id long, value string"))


def test_live_cells_enter_the_leaderboard(spark, given):
    asked = {"chunk_strategies": ["markdown"], "retrieval_strategies": ["dense", "hybrid_rrf"], "vector_backends": ["local", "qdrant"], "runtimes": ["basic", "agents_sdk"], "top_ks": [1, 2]}
    runs, board = sweep.run(spark, Settings(chat_key="k"), *given, asked, Live(), Live(), Live())
    status = {(r["label"].split(":")[0], r["label"].split(":")[1]): (r["status"], r["reason"]) for r in runs}
    assert status == {("basic", "local"): ("ok", None), ("agents_sdk", "local"): ("degraded", "runtime_fallback"), ("basic", "qdrant"): ("skipped", "missing_qdrant_url"), ("agents_sdk", "qdrant"): ("skipped", "missing_qdrant_url")}
    assert len(runs) == 16 and len(board) == 4 and {b["label"] for b in board} == {r["label"] for r in runs if r["status"] == "ok"}
    keys = [(-b["retrieval_reciprocal_rank"], -b["retrieval_precision"], -b["answer_keyword_hit_rate"], -b["citation_span_hit_rate"], b["avg_response_time_ms"]) for b in board]
    assert keys == sorted(keys) and board[0]["answer_keyword_hit_rate"] == 1.0 and board[0]["avg_response_time_ms"] > 0


def test_every_state_of_a_cell(spark, given, monkeypatch):
    docs, cases = given
    asked = {"chunk_strategies": ["fixed", "markdown"], "retrieval_strategies": ["lexical"], "chunk_sizes": [25], "chunk_overlaps": [5], "vector_backends": ["local", "qdrant"], "rerankers": ["none", "llm"]}
    chunk = sweep.chunk_documents

    def broken(documents, strategy, *sizes):
        if strategy == "markdown":
            raise ValueError("no chunks today")
        return chunk(documents, strategy, *sizes)

    monkeypatch.setattr(sweep, "chunk_documents", broken)
    runs, board = sweep.run(spark, Settings(), docs, cases, asked, Live(), Live(), Silent(), remote_url="http://localhost:1")
    assert [(*(r["label"].split(":")[k] for k in (1, 2, 4)), r["status"], r["reason"]) for r in runs] == [
        ("local", "fixed", "rr-none", "ok", None), ("local", "fixed", "rr-llm", "degraded", "reranker_fallback,reranker_not_live"),
        ("local", "markdown", "rr-none", "error", "ValueError: no chunks today"), ("local", "markdown", "rr-llm", "error", "ValueError: no chunks today"),
        *[("qdrant", s, r, "skipped", "missing_qdrant_client") for s in ("fixed", "markdown") for r in ("rr-none", "rr-llm")],
    ]
    assert len(board) == 1
    offline, none = sweep.run(spark, Settings(), docs, cases.limit(0), {"chunk_strategies": ["fixed"], "retrieval_strategies": ["dense"]})
    assert [(r["status"], r["reason"], r["summary"]) for r in offline] == [("degraded", "no_eval_cases", None)] and none == []


def test_cells_of_one_plan_equal_cells_alone(spark, given):
    """Every strategy and window size, with and without a reranker, against retrieval and evaluation of the cell by itself."""
    docs, cases = given
    asked = {"chunk_strategies": ["fixed", "markdown"], "top_ks": [1, 3], "rerankers": ["none", "llm"], "chunk_sizes": [40], "chunk_overlaps": [5]}
    cells = list(enumerate(sweep.cells(Settings(rerank_candidate_k=2, candidate_k=2), asked)))
    got = {r.run_no: r for r in sweep.evaluate_cells(cells, docs, cases, reranker=Live()).collect()}
    assert len(cells) == 32 and sorted(got) == list(range(32))
    questions = cases.selectExpr("query_id", "question AS text")
    from pyspark.sql import functions as F

    from corvane.operators.embedding import embed_column

    questions = questions.withColumn("vector", embed_column(F.col("text")))
    for no, cell in cells[::5]:
        corpus = corpus_of(sweep.chunk_documents(docs, cell.chunk_strategy, 40, 5).withColumn("embedding", embed_column(F.col("text"))))
        hits = retrieve(corpus, questions, cell, reranker=Live())
        want = evaluation.summary(evaluation.evaluate(cases, answer(questions, hits).select("query_id", "answer", "hits"))).first().asDict()
        assert {k: got[no][k] for k in want} == want, sweep.label(cell)
        assert got[no].reason.startswith("chat_fallback,embedding_fallback")


def test_too_many_cells_are_refused_before_any_is_made(spark, given):
    from corvane.errors import ConfigurationError

    with pytest.raises(ConfigurationError, match="129"):
        sweep.run(spark, Settings(), *given, {"chunk_strategies": ["fixed"], "retrieval_strategies": ["dense"], "top_ks": list(range(1, 130))})


def test_canonical_json(spark):
    from pyspark.sql import functions as F

    from corvane.functions.canonical import canonical_json

    schema = "n long, row struct<b:string,a:int,`ü \"q\"`:array<string>,m:map<string,struct<y:boolean,x:string>>>"
    rows = [
        (0, ("x\\ \"quoted\"\n\ttab / ünï 日本", -3, ["", None, "[,]"], {"z": (True, None), "a b": (None, "v"), "": None})),
        (1, (None, None, [], {})), (2, (None, 2**31 - 1, None, None)), (3, None), (4, ("}", 0, ["{"], {"k": (False, "}")})),
    ]
    frame = spark.createDataFrame(rows, schema)
    got = {r.n: r.text for r in frame.select("n", canonical_json(F.col("row"), frame.schema["row"].dataType).alias("text")).collect()}

    def plain(row):
        if row is None:
            return None
        b, a, q, m = row
        return {"b": b, "a": a, 'ü "q"': q, "m": None if m is None else {k: None if v is None else {"y": v[0], "x": v[1]} for k, v in m.items()}}

    assert got == {n: json.dumps(plain(row), sort_keys=True, ensure_ascii=False, separators=(",", ":")) for n, row in rows}
    with pytest.raises(TypeError, match="double"):
        canonical_json(F.lit(1.5), spark.createDataFrame([(1.5,)], "x double").schema["x"].dataType)


def test_identities_of_cells(spark):
    one = lambda **changes: sweep.configurations(spark, [(0, Settings(**changes))]).first().configuration_identity
    assert one() == one(chat_key="secret", docs_dir="elsewhere", index_path="/x") and len({one(), one(top_k=5), one(chunk_size=801), one(embedding_model="m")}) == 4


def test_an_index_of_a_sweep_leaves_no_corpus_and_writes_no_hash_vectors(spark, given, monkeypatch):
    from pathlib import Path

    from corvane.plans import engine
    from corvane.sources import shared

    docs, cases = given
    columns = []
    monkeypatch.setattr(engine, "staged", lambda df, label, *a, **b: columns.append(df.columns) or shared.staged(df, label, *a, **b))
    with shared.scratch(spark):
        cells = list(enumerate(sweep.cells(Settings(), {"chunk_strategies": ["fixed", "markdown"]})))
        totals = sweep.evaluate_cells(cells, docs, cases)
        left = {p.rpartition("/")[2].rpartition("-")[0] for p in shared._scopes(spark)[-1] if list(Path(p.removeprefix("file://")).glob("*.parquet"))}
        assert not left & {"corpus", "chunks", "scan-rows", "query-terms"} and "sweep-texts" in left
        assert len(columns) == 2 and not any({"vector", "embedding"} & set(c) for c in columns)
        assert totals.count() == 8
