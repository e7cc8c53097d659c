"""The corpus pipeline against a plain Python model of its five stages."""

import random

import numpy as np

import corpus_pipeline

from .cases import awkward_rows, empty
from .test_dedup import edited_rows, shingle_groups
from .test_filters_and_mix import plain_mix, toxic_corpus
from .test_text_operators import ITEMS, item_words, plain_shards

COLUMNS = "doc_id long, text string, source string, mix_plan string, group_row double, mark int, slot int, contaminated_doc int"


def corpus(spark):
    """Toxic and clean documents, near copies, copies, passages of ITEMS, nulls, repeated rows; other columns clash in name."""
    rng = random.Random(8)
    toxic, labels = toxic_corpus(spark, 400)
    rows = [(i, t) for i, t in toxic] + [(10_000 + k, r[1]) for k, r in enumerate(edited_rows()) if r[0] is not None and r[0] >= 1000]
    rows += [(20_000 + k if r[0] is not None else None, r[1]) for k, r in enumerate(awkward_rows(n=20)) if len(r[1] or "") < 20_000]
    leak = ITEMS[-1][1]
    rows += [(30_000 + k, f"start{k} {leak} and own words {k} {' '.join(f'v{k}x{j}' for j in range(30))}") for k in range(5)]
    rows += [(30_100, "some one two three"), (None, f"no id {leak}"), (400, None), (401, "")]
    rows += [rows[7], rows[7]]
    return [(*r, rng.choices(["a", "b", "c", None, "é"], [3, 3, 8, 3, 3])[0], "x", 0.5, 1, 2, 3) for r in rows], labels


def model(rows):
    """Rows after the first four stages, repeated as the mix repeats them."""
    kept = [r for r in rows if not any(x in (r[1] or "") for x in ("scoundrel", "nincompoop", "vequ"))]
    groups = shingle_groups([(r[0], r[1]) for r in kept])
    left = []
    for group in groups:
        ids = [i for i, _ in group if i is not None]
        chosen = (min(ids), next(t for i, t in group if i == min(ids))) if ids else group[0]
        left.append(min((r for r in kept if (r[0], r[1]) == chosen), key=lambda r: (r[2] is not None, r[2] or "")))
    windows = set()
    for _, text in ITEMS:
        q = item_words(text)
        k = min(10, len(q))
        windows |= {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if q else set()
    clean = []
    for r in left:
        w = item_words(r[1])
        if not any(tuple(w[i : i + len(x)]) == x for x in windows for i in range(len(w) - len(x) + 1)):
            clean.append(r)
    return kept, left, clean, [r for r, m in zip(clean, plain_mix(clean)) for _ in range(m[4])]


def test_run_against_a_plain_model(spark, tmp_path):
    rows, labels = corpus(spark)
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = model(rows)
    assert len(rows) > len(stages[0]) > len(stages[1]) > len(stages[2]) > 200 and len({r[0] for r in stages[3]}) < len(stages[2])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages):
        got = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), name)
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str), name
        docs = got
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain_shards(spark, stages[3], 2048, 1)
    assert len(want) > 15
    assert {r.slot: (r.first_doc_id, r.first_token, r.n_tokens, r.doc_ids, r.doc_tokens) for r in got} == {s: (w[0], w[1], len(w[2]), w[3], w[4]) for s, w in want.items()}
    import hashlib

    assert all(r.ids_sha256 == hashlib.sha256(np.array(want[r.slot][2], "<u2").tobytes()).hexdigest() for r in got)


def test_run_over_empty_tables(spark, tmp_path):
    empty(spark).selectExpr("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxic_stage_rejects_what_the_model_rejects(spark):
    rows, labels = toxic_corpus(spark, 200)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxicity_score int")
    kept = corpus_pipeline.toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(200) if i % 5}


def test_results_of_other_queries_survive_a_run(spark):
    from corvane.llm import simhash
    from corvane.plans.queries import bm25_topk
    from corvane.sources import shared
    from tests.conftest import DATA

    lazy = [simhash.op4_simhash(spark, str(DATA)), bm25_topk(spark, str(DATA))]
    before = list(shared._of_session[shared._key(spark)])
    made = corpus_pipeline.run(spark, str(DATA))
    added = [path.rpartition("/")[2] for path in shared._of_session[shared._key(spark)] if path not in before]
    # The result and its shards stay, nothing else.
    assert sorted(name.rpartition("-")[0] for name in added) == ["token-shards", "token_shards"]
    assert all(frame.count() > 0 for frame in (*lazy, made))
