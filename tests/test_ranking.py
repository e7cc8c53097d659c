import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.config import RetrievalSettings
from corvane.operators import bm25, embedding, ranking, rerank

from . import scalar_model as model

VOCABULARY = ["model", "attention", "rare", "the", "of", "Zeta9", "x_y", "naïve", "optimizer"]


def texts(seed, n, longest=12):
    rng = random.Random(seed)
    return [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, longest))) for _ in range(n)] + ["", "!!! ???", None]


def corpus_of(spark, rows):
    frame = spark.createDataFrame([(i, f"d.md::chunk-{i}", t, "src title") for i, t in enumerate(rows)], "position long, chunk_id string, text string, metadata_text string")
    return frame.withColumn("searchable", F.coalesce("text", F.lit(""))).withColumn("vector", embedding.embed_column(F.col("text")))


def asked(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "query_id long, text string").withColumn("vector", embedding.embed_column(F.col("text")))


def best(scores, k, tie=lambda i: i):
    order = sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: (-round(s, 9) if (s := scores[i]) else 0, tie(i)))
    return order[:k]


def rows_of(ranked):
    out = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.position, r.score))
    return out


@pytest.mark.parametrize("block_terms", [200_000, 3])
def test_bm25(spark, block_terms):
    docs, queries = texts(1, 60), texts(2, 8)
    got = {(r.query_id, r.position): r.score for r in bm25.scores(corpus_of(spark, docs), asked(spark, queries), "text", block_terms).collect()}
    want = {(q, i): s for q, t in enumerate(queries) for i, s in enumerate(model.bm25([d or "" for d in docs], t)) if s > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bm25_vectors(spark):
    docs = ["model widget", "model a", "model b", "model c", "model d"]
    got = rows_of(ranking.lexical(corpus_of(spark, docs), asked(spark, ["model rare model"]), 9))
    want = model.bm25(docs, "model rare model")
    assert [p for p, _ in got[0]] == best(want, 9)
    assert bm25.scores(corpus_of(spark, ["", None]), asked(spark, ["a"])).count() == 0


@pytest.mark.parametrize("k", [1, 3, 40])
@pytest.mark.parametrize("block_terms", [200_000, 3])
def test_a_part_that_is_scored_first_changes_no_ranking(spark, block_terms, k):
    """Parts with many, few and no rows, and with all; ties stand at the k-th place."""
    docs, queries = texts(21, 90), [*texts(22, 6), "absent"]
    corpus, questions = corpus_of(spark, docs).repartition(7), asked(spark, queries)
    want = rows_of(ranking.top_k(bm25.best(corpus, questions, k, block_terms=block_terms), k, F.col("position")))
    for share in ("position % 3 = 0", "position < 2", "false", "true"):
        got = rows_of(ranking.top_k(bm25.best(corpus, questions, k, block_terms=block_terms, part=corpus.where(share)), k, F.col("position")))
        assert {q: [p for p, _ in rows] for q, rows in got.items()} == {q: [p for p, _ in rows] for q, rows in want.items()}
        assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q]))


@pytest.mark.parametrize("block", [2048, 2])
def test_dense_and_blended(spark, block):
    docs, queries = texts(3, 50), texts(4, 6)
    corpus, questions = corpus_of(spark, docs), asked(spark, queries)
    dv, qv = [model.hash_vector(t) for t in docs], [model.hash_vector(t) for t in queries]
    share = lambda q, d: len(set(model.terms(q)) & set(model.terms(d))) / len(set(model.terms(q))) if model.terms(q) and model.terms(d) else 0.0
    dense, mixed = rows_of(ranking.dense(corpus, questions, 5, block)), rows_of(ranking.blended(corpus, questions, 5, block))
    for i, q in enumerate(queries):
        cos = [model.cosine(qv[i], v) for v in dv]
        full = [max(c, share(q, d), 0.65 * c + 0.25 * share(q, d) + 0.1 * share(q, "src title")) for c, d in zip(cos, docs)]
        assert [p for p, _ in dense.get(i, [])] == best(cos, 5)
        assert [p for p, _ in mixed.get(i, [])] == best(full, 5)


@pytest.mark.parametrize("block_terms", [200_000, 3])
def test_overlap(spark, block_terms):
    docs, queries = texts(8, 40), texts(9, 6)
    got = rows_of(ranking.overlap(corpus_of(spark, docs), asked(spark, queries), 5, block_terms))
    for i, q in enumerate(queries):
        terms = set(model.terms(q))
        share = [len(terms & set(model.terms(d))) / len(terms) if terms and d else 0.0 for d in docs]
        assert [p for p, _ in got.get(i, [])] == best(share, 5)


@pytest.mark.parametrize("what", ["lexical", "overlap"])
def test_rankings_shuffle_their_best_rows_only(spark, what):
    """Above the last join there is a limit for each query and task before the shuffle."""
    docs = corpus_of(spark, texts(7, 20)).drop("vector")
    plan = getattr(ranking, what)(docs.drop("chunk_id"), spark.createDataFrame([(0, "model the")], "query_id long, text string"), 3)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("BroadcastHashJoin")]
    assert above.count("Exchange") == 1 and above.index("Exchange") < above.rindex("WindowGroupLimit")


def test_hash_vectors(spark):
    rows = [*texts(5, 30), "attention", " é x y "]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").orderBy("i").select(embedding.embed_column(F.col("t")).alias("v")).collect()]
    assert np.allclose(got, [model.hash_vector(t) for t in rows])
    one = got[rows.index("attention")]
    assert {i for i, x in enumerate(one) if x > 0} == {9, 15, 43, 79, 81, 96, 110} and {i for i, x in enumerate(one) if x < 0} == {1, 24, 31, 46, 61, 83, 87, 90, 97}


def ranked_list(spark, names):
    return spark.createDataFrame([(0, n, i, i + 1) for i, n in enumerate(names)], "query_id long, chunk_id string, position long, rank int")


def test_fusion(spark):
    pos = {"a": 0, "b": 1, "c": 2}
    lists = [spark.createDataFrame([(0, n, pos[n], i + 1) for i, n in enumerate(x)], "query_id long, chunk_id string, position long, rank int") for x in ("ac", "bc")]
    got = [(r.chunk_id, round(r.score, 6)) for r in ranking.top_k(ranking.fuse(lists), 3, F.col("chunk_id")).orderBy("rank").collect()]
    assert got == [("c", 0.032258), ("a", 0.016393), ("b", 0.016393)]


def test_hybrid_prefers_agreement(spark):
    rows = [(0, "d::chunk-0", "unrelated", [1.0, 0.0]), (1, "d::chunk-1", "widget words", [0.92, 0.39]), (2, "d::chunk-2", "widget and further text", [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "position long, chunk_id string, text string, vector array<double>").withColumn("searchable", F.col("text"))
    queries = spark.createDataFrame([(0, "widget", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    got = ranking.hybrid(corpus, queries, 3, RetrievalSettings("hybrid_rrf")).orderBy("rank").collect()
    assert got[0].position == 1 and round(got[0].score, 6) == 0.032522
    assert ranking.rank(corpus, queries, 0).count() == 0
    assert RetrievalSettings().window(4) == 20 and RetrievalSettings().window(32) == 32


def test_candidates_have_their_own_statistics(spark):
    docs = ["alpha beta", "alpha", "gamma", "alpha alpha"]
    cands = spark.createDataFrame([(q, r + 1, p, f"c{p}", docs[p]) for q, order in enumerate(([0, 1, 2], [3, 1])) for r, p in enumerate(order)], "query_id long, rank int, position long, chunk_id string, searchable string")
    queries = spark.createDataFrame([(0, "alpha beta"), (1, "alpha")], "query_id long, text string")
    got = {(r.query_id, r.position): r.score for r in bm25.candidate_scores(cands.select("query_id", "position", F.col("searchable").alias("text")), queries).collect()}
    for q, order in enumerate(([0, 1, 2], [3, 1])):
        for p, s in zip(order, model.bm25([docs[p] for p in order], ["alpha beta", "alpha"][q])):
            assert abs(got[(q, p)] - s) < 1e-9
    assert [p for p, _ in rows_of(ranking.rerank_candidates(cands, queries, 2, "lexical"))[0]] == [0, 1]
    assert [p for p, _ in rows_of(ranking.rerank_candidates(cands, queries, 2))[0]] == [0, 1]


def some_reply(rng):
    """A reply in prose with arrays of numbers, digits in quotes, and what is neither; and the numbers that it names."""
    if rng.random() < 0.15:
        return rng.choice([None, "", "none of these fits", "(1) or (2)", "[", "[]", "[ ]"]), []
    kinds = [(lambda n: str(n), True), (lambda n: f'"{n}"', True), (lambda n: f'" {n} "', True), (lambda n: f"-{n}", False), (lambda n: f"{n}.5", False), (lambda n: f'"no {n}"', False), (lambda n: rng.choice(["null", "false", "{}"]), False)]
    entries, named = [], []
    for _ in range(rng.randint(1, 6)):
        n = rng.randint(0, 5)
        form, counts = rng.choice(kinds)
        entries.append(form(n))
        named += [n] if counts else []
    more = rng.choice(["", " then [1, 2, 3]", " as asked."])
    return f"{rng.choice(['', 'Here: ', 'Ranked by use of item ' + str(rng.randint(1, 9)) + ' '])}[{rng.choice([',', ', ', ' ,']).join(entries)}]{more}", named


def replies():
    import random

    rng = random.Random(17)
    return [(*some_reply(rng), rng.randint(1, 3)) for _ in range(14)]


@pytest.mark.parametrize("reply,named,k", replies())
def test_replies(spark, reply, named, k):
    chosen = [n for n in dict.fromkeys(named) if 1 <= n <= 3]
    want = "".join("abc"[n - 1] for n in [*chosen, *(n for n in (1, 2, 3) if n not in chosen)][:k])
    mode = "live" if chosen else "fallback"
    hits = spark.createDataFrame([(0, i + 1, c, s, "p", "t", "text") for i, (c, s) in enumerate((("a", 0.9), ("b", 0.8), ("c", 0.7)))], "query_id long, rank int, chunk_id string, score double, source_path string, title string, text string")
    replies = spark.createDataFrame([(0, reply)], "query_id long, reply string")
    got = rerank.apply_replies(hits, replies, k).orderBy("rank").collect()
    assert "".join(r.chunk_id for r in got) == want and {r.rerank_mode for r in got} == {mode}
    assert [r.score for r in got] == ([1 / (i + 1) for i in range(k)] if mode == "live" else [0.9, 0.8, 0.7][:k])
    asked_model = rerank.model_rerank(hits, k, lambda prompt: F.lit(reply)).orderBy("rank").collect()
    assert "".join(r.chunk_id for r in asked_model) == want
    assert {(r.rerank_mode, r.rerank_reason) for r in rerank.model_rerank(hits, k, None).collect()} == {("fallback", "missing_api_key")}
    single = rerank.model_rerank(hits.where("rank = 1"), k, lambda prompt: F.raise_error(F.lit("asked"))).collect()
    assert [(r.chunk_id, r.rerank_reason) for r in single] == [("a", "rerank_not_needed")]


def test_providers(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(25)], "i long, text string")

    class Good:
        def embed(self, batch):
            return [[float(len(t)), 1.0] for t in batch]

    class Bad:
        def embed(self, batch):
            if "text 7" in batch:
                raise TimeoutError("timed out")
            return [[1.0]] * len(batch)

    out, status = embedding.embed(rows, Good(), batch=4)
    assert status == {"provider": "embedding", "mode": "live", "reason": None} and {len(r.embedding) for r in out.collect()} == {2}
    out, status = embedding.embed(rows, Bad(), batch=4, retries=1, backoff_ms=1)
    assert status["mode"] == "fallback" and status["reason"] == "provider_transient_error:TimeoutError:retry_exhausted:2:max_retries:1"
    assert {len(r.embedding) for r in out.collect()} == {128}
    assert embedding.embed(rows)[1]["reason"] == "missing_api_key"


def test_each_text_is_sent_once_and_never_again(spark, tmp_path):
    """Copies cost no call, and a run that is tried again after a failure sends what is missing."""
    log = tmp_path / "sent"

    class Counting:
        def __init__(self, broken=()):
            self.broken = broken

        def embed(self, batch):
            if set(batch) & set(self.broken):
                raise ValueError("refused")
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in batch)
            return [[float(len(t)), 1.0] for t in batch]

    def sent():
        return sorted(log.read_text().split("\n")[:-1]) if log.exists() else []

    texts = [f"text {n % 20}" for n in range(200)] + [None, ""]
    rows = spark.createDataFrame([(n, t, "own", "other") for n, t in enumerate(texts)], "i long, text string, key string, vector string").repartition(5)
    journal = str(tmp_path / "journal")
    out, status = embedding.embed(rows, Counting(broken=("text 7",)), batch=3, journal=journal, round_texts=6)
    done = sent()
    assert status == {"provider": "embedding", "mode": "fallback", "reason": "provider_error:ValueError:refused"} and len(done) == len(set(done)) < 21
    out, status = embedding.embed(rows, Counting(), batch=3, journal=journal, round_texts=6)
    assert status["mode"] == "live" and sent() == sorted({t or "" for t in texts})
    got = {r.i: r for r in out.collect()}
    assert len(got) == 202 and out.columns == [*rows.columns, "embedding"] and all(got[n].embedding == [float(len(t or "")), 1.0] and got[n].key == "own" for n, t in enumerate(texts))
    more = rows.limit(0).unionByName(spark.createDataFrame([(1, "text 3", "k", "v"), (2, "new", "k", "v")], rows.schema))
    assert embedding.embed(more, Counting(), journal=journal)[0].count() == 2 and len(sent()) == 22
    assert embedding.embed(rows.limit(0), Counting(), journal=journal)[0].count() == 0


def test_plans_stay_in_the_jvm(spark):
    docs = corpus_of(spark, texts(7, 20)).drop("vector")
    plan = bm25.scores(docs, spark.createDataFrame([(0, "model the")], "query_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
    top = ranking.top_k(spark.range(100).selectExpr("id % 3 AS query_id", "id AS position", "rand(1) AS score"), 4, F.col("position"))
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [None, 2])
def test_a_corpus_without_vectors_is_hashed_by_its_scan(spark, block):
    """With and without a part that is scanned first, with equal scores, blank texts and blank queries."""
    docs, queries = texts(31, 80), [*texts(32, 6), "", "absent"]
    corpus, questions = corpus_of(spark, docs).repartition(5), asked(spark, queries)
    read = lambda rows: {(r.ranker, r.query_id, r["rank"]): (r.position, round(r.score, 9)) for r in rows.collect()}
    depths = {"dense": 5, "blended": 3}
    want = read(ranking.scanned(corpus, questions, depths, block))
    plain = corpus.drop("vector")
    assert want and read(ranking.scanned(plain, questions, depths, block)) == want
    for share in ("position % 3 = 0", "position < 2", "true"):
        assert read(ranking.scanned(plain, questions, depths, block, part=plain.where(share))) == want
