"""Rankings keep the best rows of each query and task, and never a table of queries by rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions import batches
from corvane.operators import bm25, ranking
from corvane.plans import engine

from . import scalar_model as model


def texts(seed, n, words=40):
    rng = random.Random(seed)
    return [" ".join(f"w{min(int(rng.paretovariate(0.6)), words)}" for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_a_ranking_makes_no_table_of_queries_by_documents(spark):
    docs, queries = texts(1, 300), texts(2, 40)
    corpus = spark.createDataFrame(list(enumerate(docs)), "position long, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    assert bm25.best(corpus, asked, 4).count() <= 4 * 40 * 3 < bm25.scores(corpus, asked).count()
    plan = ranking.lexical(corpus, asked, 4)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "postings" not in plan


@pytest.mark.parametrize("k", [1, 3, 50])
def test_pruned_search_is_exact(k):
    """Against the plain scores of all rows, in small pieces, with many equal scores."""
    docs, queries = texts(3, 900, 25), texts(4, 30, 25)
    known = {t.encode(): i for i, t in enumerate(sorted({t for q in queries for t in model.terms(q)}))}
    rows = [(q, known[t.encode()], 1.0 + len(t) * 0.37) for q, text in enumerate(queries) for t in sorted(set(model.terms(text)))]
    asked = batches.Asked(*(np.array(x) for x in zip(*rows)), len(queries))
    best, scores = batches.Best(len(queries), k), np.zeros((len(queries), len(docs)))
    for a in range(0, len(docs), 70):
        found = batches.Postings(pa.array(docs[a : a + 70]), known)
        asked.search(found, found.count / (found.count + found.length[found.row] / 7), np.arange(a, a + found.rows), best)
    for i, d in enumerate(docs):
        own = model.terms(d)
        for q, t, w in rows:
            c = own.count(list(known)[t].decode())
            scores[q, i] += w * c / (c + len(own) / 7) if c else 0.0
    for q in range(len(queries)):
        order = sorted(np.flatnonzero(scores[q]).tolist(), key=lambda i: (-round(scores[q, i], 9), i))[:k]
        at = best.query == q
        assert best.position[at].tolist() == order and np.allclose(best.score[at], scores[q, order])


def test_pieces_are_bounded_and_whole():
    rows = ["x" * n for n in (5, 0, 30, 4, 4, 4)] + [None, "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], ["i", "t"])
    parts = list(batches.pieces(batch, 1, rows=3, size=10))
    assert sum((p.column(1).to_pylist() for p in parts), []) == rows
    assert all(p.num_rows == 1 or (p.num_rows <= 3 and sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 10) for p in parts)
    assert [t for t in batches.terms_of(pa.array(["Aé_B İc", None]))] == [[x.lower().encode() for x in re.findall("[A-Za-z0-9_]+", "Aé_B İc")], []]


def test_a_corpus_stores_each_text_once(spark):
    from corvane.operators.chunking import chunk_documents

    docs = spark.createDataFrame([("a/1.md", "one two"), ("b/2.md", "three")], "source_path string, text string")
    corpus = engine.corpus_of(chunk_documents(docs, "fixed", 800, 120))
    path = corpus.inputFiles()[0].rpartition("/")[0]
    assert "searchable" not in spark.read.parquet(path).columns
    assert [r.searchable for r in corpus.orderBy("position").select("searchable").collect()] == ["1 1 one two", "2 2 three"] and corpus.where(F.col("metadata_text") == "1 1 1").count() == 1


def test_chunks_of_a_batch_leave_in_bounded_pieces():
    """Six texts of 1 MB in one batch: the chunks of one leave before the next is read."""
    from corvane.operators import chunking

    paths = [f"a/{n}.md" for n in range(6)]
    batch = pa.RecordBatch.from_arrays([pa.array(paths), pa.array(["t"] * 6), pa.array(["word and word. " * 70000] * 5 + ["short"])], ["source_path", "source_title", "text"])
    parts = list(chunking.chunked("fixed", 800, 120)(iter([batch])))
    assert [set(p.column(1).to_pylist()) for p in parts] == [{x} for x in paths] and [p.num_rows for p in parts] == [parts[0].num_rows] * 5 + [1]


def test_postings_are_built_without_a_row_a_term(spark):
    """Texts are dealt out by zone; nothing is grouped after that."""
    from corvane.operators import postings

    rng = random.Random(7)
    rows = [(n * 7, "", (0, 0, "", "", None, None), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for n in range(500)]
    frame = spark.createDataFrame(rows, "position long, title string, metadata struct<start:int,end:int,chunk_strategy:string,source_title:string,section_title:string,heading_level:int>, text string")
    made = postings.build(frame.repartition(5))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    want = {}
    for position, _, _, text in rows:
        for t in set(text.split()):
            want.setdefault((position >> 10, t), []).append((position & 1023, text.split().count(t), len(text.split())))
    got = {(r.zone, r.term): r for r in made.collect()}
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert list(zip(r.docs, r.tfs, r.lengths)) == want[key]
        blocks = sorted({d // postings.BLOCK for d in r.docs})
        of = lambda b, key=key: [x for x in want[key] if x[0] // postings.BLOCK == b]
        assert (r.blocks, r.most, r.shortest) == (blocks, [max(x[1] for x in of(b)) for b in blocks], [min(x[2] for x in of(b)) for b in blocks])


def test_terms_of_a_piece_are_those_of_its_texts_one_by_one():
    """Terms of 1 to 40 letters, known or not, beside each other's texts, in slices and with nulls."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcAB_9é") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 18, 40])))
    vocabulary = [word() for _ in range(300)]
    rows = [rng.choice([None, "", " ", "".join(rng.choice(vocabulary) + rng.choice(["", " ", ", ", "\n"]) for _ in range(rng.randint(0, 30)))]) for _ in range(400)]
    own = [model.terms(r or "") for r in rows]
    known = {t.encode(): i for i, t in enumerate(sorted({t for terms in own for t in terms})[::2])}
    words = batches.Words(known)
    for a, z in ((0, 400), (37, 38), (100, 390)):
        length, number = words.read(pa.array(rows).slice(a, z - a))
        assert length.tolist() == [len(t) for t in own[a:z]]
        assert number.tolist() == [known.get(t.encode(), -1) for terms in own[a:z] for t in terms]
    assert [x.tolist() for x in batches.Words({}).read(pa.array(["a", None]))] == [[1, 0], [-1]]


def test_positions_are_compared_only_where_scores_are_equal():
    class Place(str):
        compared = 0

        def __lt__(self, other):
            Place.compared += 1
            return str(self) < str(other)

    place = lambda names: np.array([*map(Place, names), None], object)[:-1]
    best = batches.Best(2, 2)
    best.add(np.array([1, 0, 0, 1]), place("dcba"), np.array([0.5, 3.0, 2.0, 0.7]))
    assert not Place.compared and best.position.tolist() == ["c", "b", "a", "d"]
    best.add(np.array([0, 0, 1]), place("xak"), np.array([2.0, 2.0 + 1e-12, 0.1]))
    assert Place.compared and best.position.tolist() == ["c", "a", "a", "d"] and best.floor.tolist() == [2.0, 0.5]


def test_many_questions_read_the_texts_once_for_statistics(spark, monkeypatch):
    """250,000 terms of questions are one block."""
    reads = []
    plain = bm25.frequencies
    monkeypatch.setattr(bm25, "frequencies", lambda *args: reads.append(1) or plain(*args))
    asked = spark.range(2500).selectExpr("id AS query_id", "concat_ws(' ', transform(sequence(0, 99), x -> concat('t', (id * 7 + x) % 5000))) AS text")
    corpus = spark.createDataFrame([(0, "t5 t6"), (1, "t6 t9999")], "position long, text string")
    assert bm25.best(corpus, asked, 1).count() > 0 and len(reads) == 1
