"""Rankings by cells against the full scan."""

import numpy as np
import pytest

from corvane.operators import ranking
from corvane.operators.cells import CellIndex


def ranks(frame):
    return {(r.query_id, r.rank, r.position, round(r.score, 9)) for r in frame.collect()}


@pytest.mark.parametrize(("spread", "least_skipped"), [(0.05, 0.7), (3.0, 0.0)])
def test_cells_lose_no_hit(spark, spread, least_skipped):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[k % 12] + spread * rng.normal(size=16)).tolist() for k in range(900)]
    vectors += [vectors[5]] * 300 + [[0.0] * 16, None, [1.0, 2.0], [-x for x in vectors[5]]]
    corpus = spark.createDataFrame([(n, v) for n, v in enumerate(vectors)], "position long, vector array<double>")
    asked = spark.createDataFrame([(n, v) for n, v in enumerate([*vectors[:900:45], [0.0] * 16, None, rng.normal(size=16).tolist()])], "query_id long, vector array<double>")
    index = CellIndex.build(corpus)
    for k in (1, 7):
        found, skipped = index.search(asked, k)
        assert ranks(found) == ranks(ranking.dense(corpus, asked, k).select("query_id", "rank", "position", "score"))
        assert skipped >= least_skipped
    assert ranks(index.search(asked, 3, block_queries=5)[0]) == ranks(ranking.dense(corpus, asked, 3).select("query_id", "rank", "position", "score"))
    # A small or useless sample costs time and no hits.
    poor = CellIndex.build(corpus, sample_rows=30, cells=2)
    assert ranks(poor.search(asked, 5)[0]) == ranks(index.search(asked, 5)[0])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "position long, vector array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "position long, vector array<double>")
    assert CellIndex.build(none).search(some.withColumnRenamed("position", "query_id"), 3)[0].count() == 0
    assert CellIndex.build(some).search(none.withColumnRenamed("position", "query_id"), 3)[0].count() == 0
