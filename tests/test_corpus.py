"""A corpus of chunks is written once, where it is made, and its rankings come in few tasks."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import bm25, ranking
from corvane.operators.chunking import chunk_documents
from corvane.plans import engine, queries
from corvane.sources import shared


def test_a_corpus_is_written_once_and_not_shuffled(spark, monkeypatch):
    written = []
    monkeypatch.setattr(engine, "staged", lambda df, label, *a, **b: written.append(df) or shared.staged(df, label, *a, **b))
    rows = [("b/2.md", "x " * 900), ("b/10.md", "three"), ("a", "y " * 9000), ("a.md", "one"), ("b/10.md", "three"), ("b/10.md", "four")]
    with shared.scratch(spark):
        corpus = engine.corpus_of(chunk_documents(spark.createDataFrame(rows, "source_path string, text string").repartition(3), "fixed", 800, 120))
        assert len(written) == 1 and "Exchange RangePartitioning" not in written[0]._jdf.queryExecution().executedPlan().toString()
        found = corpus.orderBy("position").select("position", "source_path", "chunk_index").collect()
        assert len({r.position for r in found}) == len(found) > 30
        assert [(r.source_path, r.chunk_index) for r in found] == sorted((r.source_path, r.chunk_index) for r in found)


@pytest.mark.parametrize("k", [1, 3])
def test_equal_scores_go_by_path_and_chunk_number(spark, k):
    """Copies of three texts under many paths: ties within and across tasks, the first paths stay."""
    rng = random.Random(k)
    rows = [(f"s{rng.randint(0, 3)}/{n}.md", ("red fox", "red red dog", "blue fox")[n % 3]) for n in range(120)]
    with shared.scratch(spark):
        corpus = engine.corpus_of(chunk_documents(spark.createDataFrame(rows, "source_path string, text string").repartition(5), "fixed", 800, 120)).withColumn("searchable", F.col("text"))
        asked = spark.createDataFrame([(1, "fox"), (2, "red")], "query_id int, text string")
        got = ranking.lexical(corpus, asked, k).join(corpus.select("position", "source_path", "text"), "position").orderBy("query_id", "rank").collect()
    fox = sorted(p for p, t in rows if t.endswith("fox"))[:k]
    red = sorted(p for p, t in rows if t.startswith("red red"))[:k]
    assert [r.source_path for r in got if r.query_id == 1] == fox and [r.source_path for r in got if r.query_id == 2] == red


def test_the_number_of_tasks_does_not_grow_with_the_corpus(spark):
    corpus = spark.createDataFrame([(i, f"w{i % 7}") for i in range(400)], "position long, text string").repartition(60)
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3")], "query_id long, text string")
    most = bm25.TASKS * spark.sparkContext.defaultParallelism
    assert bm25.best(corpus, asked, 4).rdd.getNumPartitions() <= most < 60
    got = sorted((r.query_id, r["rank"], r.position) for r in ranking.overlap(corpus, asked, 2).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 10)]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the given tables")
def test_hits_leave_no_corpus(spark):
    with shared.scratch(spark):
        hits = queries._hits(spark, "/root/testdata/sf0.001")
        n = hits.count()
        left = {path.rpartition("/")[2].rpartition("-")[0] for path in shared._scopes(spark)[-1] if list(Path(path.removeprefix("file://")).glob("*.parquet"))}
        assert "hits" in left and not left & {"corpus", "chunks"} and hits.count() == n > 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", ["citations", "citation_spans", "extractive_answer", "eval_metrics", "eval_summary", "failure_reasons"])
def test_no_text_of_the_corpus_is_written(spark, monkeypatch, name):
    """Only terms of questions, keys of ranked chunks and the hits are, and of these the hits alone stay."""
    written = []
    for module in (engine, queries, bm25, ranking):
        monkeypatch.setattr(module, "staged", lambda df, label, *a, **b: written.append(label) or shared.staged(df, label, *a, **b))
    with shared.scratch(spark):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
        left = [path.rpartition("/")[2].rpartition("-")[0] for path in shared._scopes(spark)[-1]]
    assert written == ["query-terms", "ranked", "hits"] and left == ["hits"]


def test_what_leaves_a_ranking_does_not_grow_with_its_tasks(spark, monkeypatch, tmp_path):
    """Chunks go on to the shuffle for what they score in the whole corpus, so most tasks send fewer than k rows a question."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(n, " ".join(rng.choices(words, k=rng.randint(5, 60))), "en", f"s{n % 3}") for n in range(1600)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    sent = []
    monkeypatch.setattr(bm25, "best", lambda *a, of=bm25.best, **b: sent.append(of(*a, **b)) or sent[-1])
    monkeypatch.setattr(queries, "documents", lambda s, sf, of=queries.documents: of(s, sf).repartition(16))
    with shared.scratch(spark):
        assert queries._hits(spark, str(tmp_path)).count() == 16 * queries.K
        assert sent[0].rdd.getNumPartitions() == 16
        assert 16 * queries.K <= sent[0].count() < 16 * queries.K * 16 / 1.5


@pytest.mark.parametrize("tasks", [1, 5])
def test_an_unwritten_corpus_gives_the_hits_of_a_written_one(spark, tasks):
    """Equal chunks of equal paths are hits of their own; paths and texts may repeat apart, and a path may be null."""
    rng = random.Random(tasks)
    rows = [(rng.choice(["a.md", "b/c.md", None]), rng.choice(["red fox", "# red\nred dog", "blue fox " * 150, " red fox", ""])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "source_path string, text string").repartition(tasks)
    asked = spark.createDataFrame([(1, "fox"), (2, "red dog"), (3, "green")], "query_id int, text string")
    columns = ("query_id", "rank", "chunk_id", "source_path", "title", "text", "chunk_index", "start_char", "end_char")
    with shared.scratch(spark):
        written, passing = (make(chunk_documents(docs, "fixed", 800, 120)) for make in (engine.corpus_of, engine.passing_corpus))
        want = ranking.lexical(written.drop("chunk_id"), asked, 400).drop("chunk_id").join(written, "position")
        got = engine.with_chunks(shared.staged(ranking.lexical(passing.drop("chunk_id"), asked, 400).drop("chunk_id"), "ranked"), passing)
        want, got = ([tuple(r) for r in x.select(*columns).orderBy("query_id", "rank").collect()] for x in (want, got))
    assert [r[:3] for r in got] == [r[:3] for r in want] and len({r[:2] for r in got}) == len(got) > 40
    # Chunks of equal scores, paths and numbers rank by row in one and by content in the other.
    assert sorted(repr(r[:1] + r[2:]) for r in got) == sorted(repr(r[:1] + r[2:]) for r in want)


def test_ranked_chunks_are_found_without_a_shuffle_of_the_corpus(spark):
    docs = spark.createDataFrame([(f"{n}.md", f"word{n % 9} " * 200) for n in range(50)], "source_path string, text string")
    corpus = engine.passing_corpus(chunk_documents(docs, "fixed", 800, 120))
    some = corpus.limit(3).select(F.lit(1).alias("query_id"), F.lit(1).alias("rank"), "position", F.lit(1.0).alias("score"))
    with shared.scratch(spark):
        plan = engine.with_chunks(shared.staged(some, "ranked"), corpus)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    # The first step above the chunks, read upwards, is the broadcast semi join; shuffles come after it.
    chunked = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    above = [line for line in lines[:chunked] if "Exchange" in line or "LeftSemi" in line]
    assert "LeftSemi" in above[-1] and "BroadcastHashJoin" in above[-1]


def test_only_small_tables_are_dealt_out_anew(spark):
    cores = spark.sparkContext.defaultParallelism
    wide, narrow = spark.range(0, 100, 1, cores - 1), spark.range(0, 100, 1, 1)
    assert queries.spread(wide).rdd.getNumPartitions() == cores - 1 and queries.spread(narrow).rdd.getNumPartitions() == cores
