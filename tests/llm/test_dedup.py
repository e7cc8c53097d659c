import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from corvane.llm import components as joined
from corvane.llm import content_sort, shingle_sets, simhash

from .cases import awkward, awkward_rows, empty, lower


@pytest.mark.parametrize(("keep", "chunk"), [("min", 50_000), ("max", 50_000), ("max", 3)])
def test_exact_duplicates_by_brute_force(spark, keep, chunk, monkeypatch):
    monkeypatch.setattr(content_sort, "CHUNK", chunk)
    groups = defaultdict(list)
    for r in awkward_rows():
        groups[r[1] or ""].append(r[0])
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (min if keep == "min" else max)(known) if known else None
        want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    for parts in (1, 7):
        got = [tuple(r) for r in content_sort.exact_duplicates(awkward(spark).repartition(parts), keep).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_exact_duplicates_of_one_text_over_many_ranges(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'same' AS text").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = content_sort.exact_duplicates(docs, "max").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.keep_id, r.group_size) for r in got} == {(4999, 5000)}
    assert sum(r.kept for r in got) == 1 and len(got) == 5000


@pytest.mark.parametrize("doc_id", ["CAST(NULL AS LONG)", "7L"])
def test_copies_without_an_id_of_their_own_span_ranges(spark, doc_id):
    docs = spark.range(4000).selectExpr(f"{doc_id} AS doc_id", "'same' AS text").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = content_sort.exact_duplicates(docs)
        rows = ranges.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 4000 and {(r.keep_id, r.group_size) for r in rows} == {(None if "NULL" in doc_id else 7, 4000)}
    sizes = [r["count"] for r in spark.read.parquet(*{f.rpartition("/")[0] for f in ranges.inputFiles() if "content-runs" in f}).groupBy("part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000


def test_a_run_of_five_million_rows_is_not_held():
    import tracemalloc

    import pyarrow as pa

    def batches():
        for k in range(100):
            n = 50_000
            yield pa.RecordBatch.from_arrays([pa.array(range(k * n, k * n + n), pa.int64()), pa.array([7] * n), pa.array([b""] * n, pa.binary()), pa.array([0] * n, pa.int32())], ["doc_id", "hashed", "content", "part"])

    rows, last = 0, None
    tracemalloc.start()
    for batch in content_sort._runs(batches()):
        rows, last = rows + batch.num_rows, batch.slice(batch.num_rows - 1).to_pylist()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 5_000_001 and last["summary"] and (last["run_min"], last["run_max"], last["run_size"]) == (0, 4_999_999, 5_000_000)
    assert peak < 60e6


def test_neighbours_with_one_hash_are_told_apart():
    """Rows arrive sorted by hash and content; a hash that two texts share is two runs."""
    import pyarrow as pa

    rows = [(3, 5, b"aa"), (1, 5, b"ab"), (2, 5, b"ab"), (9, 6, b"zz"), (None, 6, b"zz"), (4, 8, b"q")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary()), pa.array([0] * len(rows), pa.int32())], ["doc_id", "hashed", "content", "part"])
    got = [r for b in content_sort._runs(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["run"], r["run_size"], r["run_max"]) for r in got] == [(3, 0, 1, 3), (1, 1, 2, 2), (2, 1, 2, 2), (9, 2, 2, 9), (None, 2, 2, 9), (4, 3, 1, 4)]
    assert [r["edge_text"] for r in got] == [b"aa", b"ab", None, None, None, b"q"]


def test_exact_duplicates_after_normalising(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "A b"), (2, "a  B")], "doc_id long, text string")
    got = content_sort.exact_duplicates(docs, normalise=lambda c: F.lower(F.regexp_replace(c, " +", " "))).collect()
    assert {r.keep_id for r in got} == {1}


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(ids, fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in range(len(fps)):
        members[root(i)].append(ids[i])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return [least[root(i)] for i in range(len(fps))]


@pytest.mark.parametrize("radius,tile", [(2, 2048), (2, 3), (8, 4)])
def test_near_duplicates_by_brute_force(spark, radius, tile):
    rows = awkward_rows()
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{fp:016x}", c) for r, fp, c in zip(rows, fps, components([r[0] for r in rows], fps, radius))]
    got = [tuple(r) for r in simhash.near_duplicates(awkward(spark), radius=radius, tile=tile, cell_rows=tile).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_links_of_dense_and_chained_fingerprints(spark):
    rng = np.random.default_rng(3)
    start = int(rng.integers(0, 2**63))
    chain, fps = start, [start]
    for k in range(40):
        chain ^= 3 << (k % 62)
        fps.append(chain)
    fps += [start ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)][:900]
    fps += [int(x) for x in rng.integers(0, 2**63, 300)]
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    want = components(fps, fps, 2)
    for tile in (2048, 64):
        roots = {r.node % 2**64: r.root for r in joined.connected(simhash.near_links(nodes, 2, tile, 4 * tile)).collect()}
        groups, expected = defaultdict(set), defaultdict(set)
        for x, w in zip(fps, want):
            groups[roots.get(x, x)].add(x)
            expected[w].add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("tile", [4, 16, 256])
def test_tiles_by_brute_force(tile):
    """One large cell among small ones: every link's ends stay connected, and far population counts are skipped."""
    rng = np.random.default_rng(tile)
    base = int(rng.integers(0, 2**63))
    fps = {int(x) for x in rng.integers(0, 2**63, 40)} | {base ^ int(x) for x in 1 << rng.integers(0, 62, 30)}
    fps |= {int(x) for k in range(0, 64, 4) for x in ((1 << k) - 1, ((1 << k) - 1) | 1 << 63)}
    fps = np.array(sorted(fps), np.uint64)
    cells = np.where(np.arange(len(fps)) % 5 > 0, 7, rng.integers(0, 12, len(fps)))
    pops = np.bitwise_count(fps).astype(np.int64)
    order = np.lexsort((pops, cells))
    cells, pops, fps = cells[order], pops[order], fps[order]
    a, b, skipped = simhash.tile_links(cells, pops, fps, np.zeros(len(fps), np.int64), 2, tile)
    assert (skipped > 0) == (tile < 256)
    at = {(c, f): i for i, (c, f) in enumerate(zip(cells.tolist(), fps.tolist()))}
    label = np.arange(len(fps))
    want = np.arange(len(fps))
    for i in range(len(fps)):
        for j in range(i):
            if cells[i] == cells[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 2:
                want[want == want[i]] = want[j]
    of = defaultdict(list)
    for (c, f), i in at.items():
        of[f].append(i)
    for x, y in zip(a.tolist(), b.tolist()):
        assert (x ^ y).bit_count() <= 2
        for i in of[x]:
            for j in of[y]:
                if cells[i] == cells[j]:
                    label[label == label[i]] = label[j]
    same = lambda v: {frozenset(np.flatnonzero(v == k).tolist()) for k in set(v.tolist())}
    assert same(label) == same(want)


def test_two_sides_of_a_cell_are_compared_across_only():
    fps = np.array([1, 1 << 10, 1 << 20, 1 << 30], np.uint64)
    one = np.ones(4, np.int64)
    a, b, _ = simhash.tile_links(one, one, fps, np.array([1, 1, 2, 2]), 2)
    pairs = {frozenset(p) for p in zip(a.tolist(), b.tolist())}
    assert pairs == {frozenset((int(fps[i]), int(fps[j]))) for i in (0, 1) for j in (2, 3)}


@pytest.mark.parametrize("same", [True, False])
def test_spanning_links_of_dense_matrices(same):
    rng = np.random.default_rng(4)
    for density in (0.02, 0.1, 0.9):
        near = rng.random((90, 90)) < density
        if same:
            near |= near.T
            np.fill_diagonal(near, False)
        x, y = simhash.spanning(near, same)
        assert near[x, y].all() and len(x) <= max(64, 4 * 180)
        full = near if same else np.block([[np.zeros((90, 90), bool), near], [near.T, np.zeros((90, 90), bool)]])
        used = np.zeros_like(full)
        used[x, y if same else y + 90] = True
        used |= used.T

        def reach(m):
            r = m | np.eye(len(m), dtype=bool)
            for _ in range(9):
                r = (r.astype(np.int32) @ r.astype(np.int32)) > 0
            return r

        assert (reach(full) == reach(used)).all()


def test_keep_one_row_of_each_group(spark):
    docs = awkward(spark)
    rows = awkward_rows()
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = set(components([r[0] for r in rows], fps, 2))
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_keep_one_tells_groups_without_an_id_of_their_own_apart(spark):
    unlike = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    rows = [(None, unlike[0], "x"), (None, unlike[1], "y"), (7, unlike[2], "z"), (7, unlike[3], "v"), (7, unlike[3], "u"), (8, unlike[3], "w"), (None, unlike[3], "t")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[1], rows[2], rows[4]], key=str)


def test_empty_tables(spark):
    assert content_sort.exact_duplicates(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


def edited_rows():
    """Texts with edited copies around a similarity of 0.8, a large group of near copies, and awkward rows."""
    import random

    rng = random.Random(5)
    text = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(5000)) for _ in range(n)]
    texts = []
    for _ in range(40):
        base = text(rng.randint(40, 300))
        texts.append(base)
        for edits in (1, 2, 4, 6):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(copy)
    base = text(120)
    for k in range(60):
        copy = list(base)
        copy[rng.randrange(120)] = f"own{k}"
        texts.append(copy)
    return [(r[0], r[1]) for r in awkward_rows()] + [(1000 + i, " ".join(t)) for i, t in enumerate(texts)]


def shingle_groups(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i])
    return list(groups.values())


@pytest.mark.parametrize("tile", [1024, 12])
def test_pipeline_keeps_one_of_texts_of_true_similarity(spark, tile):
    rows = edited_rows()
    want = []
    for group in shingle_groups(rows):
        ids = [r[0] for r in group if r[0] is not None]
        want.append(min(ids) if ids else None)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = simhash.keep_one(docs, similarity=0.8, tile=tile)
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(want, key=str)
    assert 200 > len(want) > 100


def test_large_buckets_compare_what_their_leaders_leave_apart(spark):
    """Two families share all bands here, as if by chance: every family is still found whole."""
    from pyspark.sql import functions as F

    rows = [(i, f"{'a b c d e f g h' if i % 3 else 'p q r s t u v w'} x{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    real = shingle_sets.shingled

    def one_key(*args, **options):
        return real(*args, **options).withColumn("keys", F.array(F.lit(1).cast("long")))

    shingle_sets.shingled = one_key
    try:
        got = simhash.keep_one(docs, similarity=0.5, shingle=3, tile=4, radius=64).collect()
    finally:
        shingle_sets.shingled = real
    assert sorted(r.doc_id for r in got) == [0, 1]


def test_pipeline_near_duplicates_of_no_rows_and_no_ids(spark):
    near = lambda docs: simhash.keep_one(docs, similarity=0.8)
    assert near(empty(spark)).count() == 0
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(base)), (None, " ".join(["edited", *base[1:]])), (None, "another text"), (1, None), (2, " "), (3, " ".join(base[:50]))]
    got = near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {r.doc_id for r in got} == {None, 1, 3}


def test_pipeline_compares_fingerprints_tile_by_tile(spark, monkeypatch):
    """Texts that share no band: the links of the tile comparison are found, checked by similarity, and nothing else is dropped."""
    from pyspark.sql import functions as F

    from corvane.llm.shingles import shingle_hashes

    mark = lambda words: int(simhash.simhash(shingle_hashes(" ".join(words).encode(), 5, 42)))
    families = [[f"w{f}x{i}" for i in range(600)] for f in range(6)]
    rows = []
    for f, words in enumerate(families):
        rows.append((10 * f, " ".join(words)))
        copy = next(c for n in range(600) if 0 < (mark(c := [*words[:n], "edited", *words[n + 1 :]]) ^ mark(words)).bit_count() <= 2)
        rows.append((10 * f + 1, " ".join(copy)))
    real, seen = shingle_sets.shingled, []

    def apart(*args, **options):
        return real(*args, **options).withColumn("keys", F.array("row"))

    def tiles(nodes, *args, **options):
        seen.append(nodes.count())
        return links(nodes, *args, **options)

    links = simhash.near_links
    monkeypatch.setattr(shingle_sets, "shingled", apart)
    monkeypatch.setattr(simhash, "near_links", tiles)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(docs, similarity=0.8).collect()) == [10 * f for f in range(6)] and seen == [12]
    # A link of fingerprints below the similarity is none.
    monkeypatch.setattr(simhash, "near_links", lambda nodes: nodes.alias("x").crossJoin(nodes.alias("y")).selectExpr("x.fp AS a", "y.fp AS b").where("a < b"))
    assert sorted(r.doc_id for r in simhash.keep_one(docs, similarity=0.8).collect()) == [10 * f for f in range(6)]
