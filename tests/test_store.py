"""The store through changes: rows, statistics and rankings against plain rebuilds."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.errors import StoreError
from corvane.operators import bm25, postings, ranking
from corvane.operators.store import ParquetStore, Segment, Version

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "Rare", "x_1", "über", "42"]


def chunk(path, n, text, vector=(1.0,)):
    about = (0, len(text), "fixed", path, None if n % 2 else "Part One", 1)
    return (f"{path}::chunk-{n}", path, "Title" if n % 3 else "", text, n, 0, len(text), about, list(vector))


def frame(spark, rows):
    from corvane.operators.store import CHUNK_SCHEMA

    return spark.createDataFrame(rows, CHUNK_SCHEMA)


def some_chunks(rng, path):
    return [chunk(path, n, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 30])))) for n in range(rng.randint(1, 4))]


def searchable(row):
    return " ".join(x for x in (row[2], row[7][4], row[3]) if x)


def terms_of(row):
    import re

    return [t.lower() for t in re.findall("[A-Za-z0-9_]+", searchable(row))]


def test_random_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    store, now, numbers = ParquetStore(tmp_path / "s", most_segments=3), {}, []
    asked = spark.createDataFrame([(k, " ".join(rng.sample(WORDS, 3))) for k in range(5)] + [(8, "nowhere !!!"), (9, "")], "query_id long, text string")
    for _ in range(5):
        paths = [f"d/{k}.md" for k in rng.sample(range(12), rng.randint(1, 6))]
        gone = [p for p in now if rng.random() < 0.15]
        new = {p: some_chunks(rng, p) for p in paths if p not in gone}
        now = {p: rows for p, rows in now.items() if p not in gone} | new
        version = store.apply(frame(spark, [c for rows in new.values() for c in rows]), spark.createDataFrame([(p,) for p in (*paths, *gone)], "source_path string"))
        numbers.append(version.number)
        live = sorted((c for rows in now.values() for c in rows), key=lambda c: (c[1], c[4]))
        assert sorted((r.chunk_id, r.text) for r in store.load(spark, vectors=False).collect()) == sorted((c[0], c[3]) for c in live)
        df = {}
        for c in live:
            for t in set(terms_of(c)):
                df[t] = df.get(t, 0) + 1
        assert {r.term: r.df for r in store.statistics(spark).collect()} == df
        assert version.chunks == len(live) and version.average == pytest.approx(sum(len(terms_of(c)) for c in live) / max(len(live), 1))
    assert len(store.version().segments) <= 3 and numbers == sorted(numbers)
    # Rankings over the stored postings are those over the texts, numbered in order of path and chunk number.
    corpus = spark.createDataFrame([(n, c[0], searchable(c)) for n, c in enumerate(live)], "position long, chunk_id string, text string")
    for k, pilots in ((2, (1, 2)), (50, (1,))):
        want = {(r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in ranking.lexical(corpus, asked, k).collect()}
        for pilot in pilots:
            got = {(r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in store.lexical(asked, k, pilot=pilot).collect()}
            assert got == want
    assert store.lexical(asked, 0).count() == 0 and store.lexical(asked.limit(0), 3).count() == 0
    merged = store.merge()
    assert len(merged.segments) == 1 and merged.chunks == len(live) and {r.term: r.df for r in store.statistics(spark).collect()} == df
    assert {(r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in store.lexical(asked, 50).collect()} == want


def size_of(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def test_a_small_change_writes_little_and_old_readers_stay(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(120))
    rows = [chunk(f"d/{k:04d}.md", 0, text()) for k in range(1500)]
    store = ParquetStore(tmp_path / "s")
    store.save(frame(spark, rows))
    before, reader = size_of(tmp_path), store.load(spark)
    first = store.version()
    changed = [f"d/{k:04d}.md" for k in range(0, 1500, 100)]
    replaced = spark.createDataFrame([(p,) for p in changed], "source_path string")
    store.apply(frame(spark, [chunk(p, 0, "new text") for p in changed[1:]]), replaced)
    assert size_of(tmp_path) - before < 0.05 * before
    assert store.load(spark).count() == 1499 and store.load(spark).where("text = 'new text'").count() == 14
    # A reader of the version before is not disturbed, and it can be opened again while it is kept.
    assert reader.count() == 1500 and store.load(spark, version=first.number).count() == 1500
    store.save(frame(spark, rows[:3]))
    store.save(frame(spark, rows[:2]))
    assert store.load(spark).count() == 2 and len(list((tmp_path / "s" / "segments").iterdir())) == 2 and len(list((tmp_path / "s" / "log").glob("0*.json"))) == 2


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = ParquetStore(tmp_path / "s"), ParquetStore(tmp_path / "s")
    a.save(frame(spark, [chunk("a", 0, "one")]))
    base = b.version()
    a.apply(frame(spark, [chunk("b", 0, "two")]), spark.createDataFrame([("b",)], "source_path string"))
    # The second writer was paused since it read the version before.
    with pytest.raises(StoreError, match="another writer"):
        b._commit(base, frame(spark, [chunk("c", 0, "three")]), None)
    assert sorted(r.text for r in b.load(spark).collect()) == ["one", "two"] and [f for f in (tmp_path / "s" / "log").iterdir() if f.suffix not in (".json", ".crc")] == []
    assert len(list((tmp_path / "s" / "segments").iterdir())) == 2
    with pytest.raises(StoreError, match="one length"):
        a.apply(frame(spark, [chunk("d", 0, "x", (1.0, 2.0))]), spark.createDataFrame([("d",)], "source_path string"))
    body = json.loads(a.pointer.read_text())
    assert body["number"] == 2 and Version(2, tuple(Segment(**s) for s in body["segments"])) == a.version()


def test_blocks_that_cannot_matter_are_not_read(spark):
    """All documents of a table against all its test items: under a third of the posting blocks are read."""
    from corvane.plans import queries

    sf = "/root/testdata/sf0.01"
    store = queries._document_store(spark, sf)
    found = store.lexical_scores(queries.benchmark(spark, sf), 4)
    blocks, read = found.agg(F.sum("blocks"), F.sum("read")).first()
    assert 0 < read < blocks / 3, (read, blocks)


def test_postings_of_a_zone(spark):
    rows = spark.createDataFrame([(5, "", (0, 0, "", "", None, None), "b a b"), (6, "T", (0, 0, "", "", "S", None), ""), (1024 + 1023, "", (0, 0, "", "", None, None), "a"), (1100, "", (0, 0, "", "", None, None), "...")], "position long, title string, metadata struct<start:int,end:int,chunk_strategy:string,source_title:string,section_title:string,heading_level:int>, text string")
    got = {(r.zone, r.term): (r.docs, r.tfs, r.lengths, r.blocks, r.most, r.shortest) for r in postings.build(rows).collect()}
    block = lambda doc: doc // postings.BLOCK
    assert got == {
        (0, "b"): ([5], [2], [3], [block(5)], [2], [3]), (0, "a"): ([5], [1], [3], [block(5)], [1], [3]), (0, "t"): ([6], [1], [2], [block(6)], [1], [2]),
        (0, "s"): ([6], [1], [2], [block(6)], [1], [2]), (1, "a"): ([1023], [1], [1], [block(1023)], [1], [1]),
    }
    assert tuple(postings.sizes(rows).first()) == (4, 6) and bm25.K1 > 0
