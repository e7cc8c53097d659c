"""Benchmark decontamination with a positional inverted index.

The index is distributed by documents: each task turns a run of documents into
one posting shard, which holds for every word of its documents the sorted
positions.  The shards are written to the shared folder once and serve any
number of test sets.  A search intersects, shard by shard, the position lists
of a window's words, each shifted by the word's offset in the window, from the
shard's rarest word on, for all windows at once; within a tolerance the same
intersection gives proximity matches.  Postings of a document never leave its
shard, so no word is gathered in one place however frequent it is, and only
the matches are shuffled.

Test items are handled in blocks of bounded size: the words and windows of one
block are what is sent to the tasks, whatever the size of the test set.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.block_dictionary import pack, unpack
from corvane.llm.staging import fresh, join_side, scratch, staged

WINDOW = 10
SLOP = 3
BLOCK_BYTES = 8_000_000
PIECE_WORDS = 100_000
SHARD_WORDS = 500_000
SLAB = 500_000
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_INDEX_SCHEMA = "shard long, doc_ids array<long>, sizes array<int>, words array<binary>, counts binary, steps binary"
_MATCH_SCHEMA = "shard long, nth int, item_id long, exact boolean, first int, past int"


def words(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII."""
    return text.translate(_WORDS).split() if text else []


def item_pieces(items: DataFrame, window: int = WINDOW, piece_words: int = PIECE_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, piece, body)``: space-joined words; a long item is cut into pieces that share window - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                for k, i in enumerate(range(0, max(1, len(found) - window + 1), piece_words)):
                    if found:
                        out.append((item_id, k, b" ".join(found[i : i + piece_words + window - 1])))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["item_id", "piece", "body"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "item_id long, piece int, body binary")


class TestWindows:
    """The words and distinct windows of one block of test items, as arrays that can be sent to tasks."""

    __test__ = False

    def __init__(self, pieces: list[tuple[int | None, bytes]], window: int = WINDOW):
        item_ids = list(dict.fromkeys(item_id for item_id, _ in pieces))
        place = {item_id: k for k, item_id in enumerate(item_ids)}
        numbers: dict[bytes, int] = {}
        grids, owners = [], []
        for item_id, body in pieces:
            ids = np.array([numbers.setdefault(w, len(numbers)) for w in body.split()], np.int64)
            if len(ids) >= window:
                grid = np.lib.stride_tricks.sliding_window_view(ids, window)
            else:
                grid = np.full((1, window), -1, np.int64)
                grid[0, : len(ids)] = ids
            grids.append(grid)
            owners.append(np.full(len(grid), place[item_id], np.int64))
        grid = np.concatenate(grids) if grids else np.zeros((0, window), np.int64)
        self.grid, inverse = np.unique(grid, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([inverse.reshape(-1), np.concatenate(owners) if owners else inverse.reshape(-1)], axis=1), axis=0)
        #: The items of window w are ``owners[owner_at[w] : owner_at[w + 1]]``, places in ``item_ids``.
        self.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(self.grid) + 1))
        self.owners = pairs[:, 1].copy()
        self.words = list(numbers)
        self.item_ids = item_ids


def build_index(docs: DataFrame, gap: int = WINDOW + 2 * SLOP, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Posting shards of all words of ``docs``; one row per shard.

    ``counts`` are the lengths of the position lists of ``words``, and
    ``steps`` the lists themselves, each as its first position and the
    differences.  Positions run through the documents of the shard with ``gap``
    empty places before each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId() << 32 if task else 0
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        doc_ids, sizes, ids = [], [], []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, held
            term = np.concatenate(ids)
            place = np.arange(len(term)) + np.repeat(gap * np.arange(1, len(sizes) + 1), sizes)
            order = np.argsort(term, kind="stable")
            place = place[order]
            counts = np.bincount(term, minlength=len(numbers))
            steps = np.diff(place, prepend=0)
            firsts = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)[: len(counts)]
            steps[firsts] = place[firsts]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary())
            row = (shard, doc_ids, sizes, list(numbers), pack(counts), pack(steps))
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["shard", "doc_ids", "sizes", "words", "counts", "steps"])
            for x in (numbers, doc_ids, sizes, ids):
                x.clear()
            shard += 1
            held = 0
            return out

        for batch in batches:
            texts = batch.column(1)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                found = words(texts[k].as_py())
                ids.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                doc_ids.append(doc_id)
                sizes.append(len(found))
                held += len(found) + gap
                if held >= shard_words:
                    yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, _INDEX_SCHEMA)


def _postings(words: list[bytes], counts: np.ndarray, steps: np.ndarray, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The shard's postings of the ``known`` words as sorted keys (number << 32 | position), and their number per known word."""
    number = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
    ends = np.cumsum(counts)
    total = np.r_[0, np.cumsum(steps)]
    mine = np.flatnonzero(number >= 0)
    mine = mine[np.argsort(number[mine])]
    n = counts[mine]
    at = np.repeat(ends[mine] - np.cumsum(n), n) + np.arange(n.sum())
    place = total[at + 1] - np.repeat(total[ends[mine] - n], n)
    per_word = np.zeros(len(known) + 1, np.int64)
    per_word[number[mine]] = n
    return (np.repeat(number[mine], n) << 32) + place, per_word


def _within(keys: np.ndarray, wanted: np.ndarray, reach: int) -> np.ndarray:
    """Whether a posting lies at most ``reach`` from each wanted key."""
    low = np.searchsorted(keys, wanted - reach)
    return (low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] <= wanted + reach)


def _found(grid: np.ndarray, keys: np.ndarray, per_word: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(window, start, exact)`` of all exact and proximity matches of one shard, in slabs."""
    per_word[-1] = np.iinfo(np.int64).max  # the filler -1 of short windows sorts last
    able = np.flatnonzero((per_word[grid] > 0).all(axis=1))
    if not len(able) or not len(keys):
        return
    order = np.argsort(per_word[grid[able]], axis=1, kind="stable")
    rare = np.take_along_axis(grid[able], order, axis=1)
    first_key = np.searchsorted(keys, rare[:, 0] << 32)
    n = per_word[rare[:, 0]]
    cuts = np.r_[0, np.cumsum(n)]
    i = 0
    while i < len(able):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + SLAB, "right")) - 1)
        w = np.repeat(np.arange(i, j), n[i:j])
        at = np.arange(len(w)) - np.repeat(cuts[i:j] - cuts[i], n[i:j]) + first_key[w]
        start = (keys[at] & 0xFFFFFFFF) - order[w, 0]
        # With all words within slop of their places, two of them are at most twice that from each other's.
        for k in range(1, grid.shape[1]):
            word = rare[w, k]
            ok = (word < 0) | _within(keys, (word << 32) + start + order[w, k], 2 * slop)
            w, start = w[ok], start[ok]
        if slop:
            start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            w = np.repeat(w, 2 * slop + 1)
        exact = np.ones(len(w), bool)
        for k in range(grid.shape[1]):
            word = rare[w, k]
            wanted = (word << 32) + start + order[w, k]
            ok = (word < 0) | _within(keys, wanted, slop)
            exact &= (word < 0) | _within(keys, wanted, 0)
            w, start, exact = w[ok], start[ok], exact[ok]
        if len(w):
            yield able[w], start, exact
        i = j


def search(index: DataFrame, tests: TestWindows, slop: int = SLOP, gap: int = WINDOW + 2 * SLOP) -> DataFrame:
    """Word spans of ``tests`` in the index: shard, nth document of it, item_id, exact, first, past.

    Exact spans are the union of a test item's phrase matches in a document.
    The other spans hold, for some start, all words of a window, each at most
    ``slop`` from its place.  ``gap`` is the index's.
    """
    shared = index.sparkSession.sparkContext.broadcast((tests.words, tests.grid, tests.owner_at, tests.owners, tests.item_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test_words, grid, owner_at, owners, item_ids = shared.value
        known = {w: k for k, w in enumerate(test_words)}
        length = (grid >= 0).sum(axis=1)
        for batch in batches:
            for r in range(batch.num_rows):
                shard, sizes = batch.column(0)[r].as_py(), batch.column(1)[r].values.to_numpy().astype(np.int64)
                keys, per_word = _postings(batch.column(2)[r].as_py(), *(unpack(batch.column(k)[r].as_py()) for k in (3, 4)), known)
                starts_at = np.cumsum(sizes + gap) - sizes  # of each document
                found = []
                for w, first, exact in _found(grid, keys, per_word, slop):
                    several = owner_at[w + 1] - owner_at[w]
                    nth = np.arange(several.sum()) - np.repeat(np.cumsum(several) - several, several)
                    item = owners[np.repeat(owner_at[w], several) + nth]
                    found.append((item, *(np.repeat(x, several) for x in (first, exact, length[w]))))
                if not found:
                    continue
                item, first, exact, size = (np.concatenate(x) for x in zip(*found))
                nth = np.searchsorted(starts_at, first + slop, "right") - 1
                first = first - starts_at[nth]
                past = np.minimum(first + size, sizes[nth])
                first = np.maximum(first, 0)
                order = np.lexsort((first, exact, item, nth))
                item, first, past, exact, nth = (x[order] for x in (item, first, past, exact, nth))
                # Spans of one document, item and kind that touch become one.
                latest = np.maximum.accumulate(past + (np.cumsum(np.r_[False, (item[1:] != item[:-1]) | (nth[1:] != nth[:-1]) | (exact[1:] != exact[:-1])]) << 32)) & 0xFFFFFFFF
                new = np.r_[True, (item[1:] != item[:-1]) | (nth[1:] != nth[:-1]) | (exact[1:] != exact[:-1]) | (first[1:] > latest[:-1])]
                last = np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]
                columns = [np.full(len(last), shard), nth[new].astype(np.int32), [item_ids[k] for k in item[new].tolist()], exact[new], first[new].astype(np.int32), latest[last].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if k == 2 else pa.array(c) for k, c in enumerate(columns)], ["shard", "nth", "item_id", "exact", "first", "past"])

    return index.select("shard", "sizes", "words", "counts", "steps").mapInArrow(run, _MATCH_SCHEMA)


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All matches of :func:`search` in an index of gap ``window + 2 * slop``, for a test set of any size."""
    pieces = staged(item_pieces(items, window), "test-pieces")
    total = pieces.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks))
    spans = []
    for k in range(blocks):
        rows = pieces.where(block == k).select("item_id", "body").collect()
        tests = TestWindows([(r.item_id, bytes(r.body)) for r in rows], window)
        spans.append(staged(search(index, tests, slop, window + 2 * slop), "spans", lasting=True))
    return reduce(DataFrame.unionByName, spans)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    A word is hit where any window of a test item occurs in full; an item with
    fewer words than a window is one window.  ``n_near_items`` counts further
    items of which a window occurs with its words displaced: for some start each
    of them is at most ``slop`` from its place.
    Null and empty texts have no words; with no test items nothing is hit; an
    empty table gives an empty result; rows that repeat an id count on their own.
    Items without an id are one item, which counts in n_hit, n_items and
    n_near_items and has no name in items_sha256.
    """
    n_distinct = F.countDistinct("item_id") + F.max(F.col("item_id").isNull().cast("int"))
    with scratch(docs.sparkSession):
        index = staged(build_index(docs, window + 2 * slop, id_col=id_col, text_col=text_col), "postings")
        listed = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("nth", "d"))
        listed = staged(listed.select("shard", "nth", F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").cast("long").alias("n_words")), "indexed", lasting=True)
        spans = matches(index, items, window, slop, block_bytes)
    before = Window.partitionBy("shard", "nth").orderBy("first", "past").rowsBetween(Window.unboundedPreceding, -1)
    exact = spans.where("exact").withColumn("covered", F.coalesce(F.max("past").over(before), F.lit(0)))
    exact = exact.groupBy("shard", "nth").agg(
        F.sum(F.greatest(F.lit(0), F.col("past") - F.greatest("first", "covered"))).cast("long").alias("n_hit"),
        n_distinct.alias("n_items"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"),
    )
    near = spans.groupBy("shard", "nth").agg(n_distinct.alias("n_any"))
    joined = listed.join(join_side(exact.join(near, ["shard", "nth"], "full"), spans.count()), ["shard", "nth"], "left")
    n_items = F.coalesce("n_items", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        (F.coalesce("n_any", F.lit(0)) - n_items).cast("long").alias("n_near_items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a test window; columns unchanged.

    Each row is judged by its own text, whatever its id: rows without an id,
    or with the id of a contaminated row, stay if they are clean.  Contaminated
    texts are known by a 64-bit hash, so no copy of ``docs`` is written.
    """
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    name = fresh(docs, "contaminated_doc")
    with scratch(docs.sparkSession):
        found = contamination(docs.select(mark.alias("mark"), F.col(text_col).alias("text")), items, id_col="mark", **options).where("contaminated")
        bad = staged(found.select(F.struct("doc_id").alias(name)).distinct(), "contaminated", lasting=True)
    return docs.join(join_side(bad, bad.count()), mark == F.col(f"{name}.doc_id"), "left_anti")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents),
i AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
  FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(s) WHERE len(w) > 0),
dw AS (
  SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS win
  FROM d, (SELECT DISTINCT k FROM iw), unnest(range(1, len(w) - k + 2)) AS t(p)),
hits AS (SELECT DISTINCT r, item_id, p, k FROM dw JOIN iw USING (k, win)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM hits, unnest(range(p, p + k)) AS t(q) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r),
dword AS (SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
iword AS (SELECT k, win, o, word, n FROM (SELECT DISTINCT k, win, o, string_split(win, ' ')[o] AS word FROM iw, unnest(range(1, k + 1)) AS t(o))
  LEFT JOIN (SELECT word, count(*) AS n FROM dword GROUP BY word) USING (word)),
rarest AS (SELECT win, arg_min(o, n) AS o, arg_min(word, n) AS word FROM iword GROUP BY win HAVING count(n) = count(*)),
starts AS (SELECT DISTINCT r, win, p - o + 1 + e AS s FROM rarest JOIN dword USING (word), unnest(range(-3, 4)) AS t(e)),
near AS (SELECT r, win FROM (SELECT r, s, win, w, string_split(win, ' ') AS q FROM starts JOIN d USING (r))
  WHERE len(list_filter(range(1, len(q) + 1), lambda o: s + o + 2 < 1 OR NOT list_contains(w[greatest(1, s + o - 4) : s + o + 2], q[o]))) = 0),
anyof AS (SELECT r, count(*) AS n_any FROM (SELECT DISTINCT r, item_id FROM near JOIN iw USING (win)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       (coalesce(n_any, 0) - coalesce(n_items, 0))::BIGINT AS n_near_items
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r) LEFT JOIN anyof USING (r)
"""
