import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import decontaminate, hidden_markov, token_counts, token_shards
from corvane.llm.staging import new_path

from .cases import awkward, awkward_rows, empty, lower


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


ITEMS = [(1, " ".join(awkward_rows()[5][1].split()[:15]) if awkward_rows()[5][1] else "w1 w2"), (2, "zz zz zz zz zz zz zz zz zz zz zz"), (3, "one two"), (4, ""), (5, None), (10, "ONE!"), (6, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]


def slow_near(words, slop=3):
    """Items of which all words of a window lie within ``slop`` of their places, for some start."""
    places, found = {}, 0
    for p, w in enumerate(words):
        places.setdefault(w, []).append(p)
    near = lambda word, at: any(abs(p - at) <= slop for p in places.get(word, ()) if at - slop <= p <= at + slop)
    for _, text in ITEMS:
        q = item_words(text)
        k = min(10, len(q))
        windows = {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if q else set()
        windows = {w for w in windows if all(x in places for x in w)}
        starts = {w: {p - w.index(x) + d for x in [min(w, key=lambda x: len(places[x]))] for p in places[x] for d in range(-slop, slop + 1)} for w in windows}
        found += any(all(near(x, s + o) for o, x in enumerate(w)) for w in windows for s in starts[w])
    return found


@pytest.mark.parametrize("block_bytes", [8_000_000, 40])
def test_contamination_by_brute_force(spark, block_bytes):
    import hashlib

    docs = awkward_rows() + [(900, "Start w1 w2 w3 w4 w5 w6, w7 w8 w9 w10 w11 end", None, "", 0.0, 0, 0, 0), (901, "w1 w2 w3 w4 w5 and w6 w7 w8 w9 w10", None, "", 0.0, 0, 0, 0)]
    want = []
    for r in docs:
        w = item_words(r[1])
        hit, names = set(), set()
        for item, text in ITEMS:
            q = item_words(text)
            k = min(10, len(q))
            windows = {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if q else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    names.add(str(item))
        want.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    frame = spark.createDataFrame(docs, awkward(spark).schema).coalesce(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(frame, items, block_bytes=block_bytes)
    rows = got.collect()
    assert sorted((tuple(r)[:6] for r in rows), key=str) == sorted(want, key=str)
    near = [(r[0], slow_near(item_words(r[1])) - w[3]) for r, w in zip(docs, want)]
    assert sorted(((r.doc_id, r.n_near_items) for r in rows), key=str) == sorted(near, key=str)
    assert next(r for r in rows if r.doc_id == 901).n_near_items == 1
    kept = decontaminate.drop_contaminated(frame, items)
    assert kept.columns == frame.columns
    bad = {w[0] for w in want if w[5]}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if w[0] not in bad), key=str)


def test_clean_rows_stay_beside_contaminated_rows_of_their_id(spark):
    leak = "Start w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 end"
    rows = [(None, leak), (None, "clean a"), (None, "clean b"), (5, leak), (5, "clean c"), (6, leak), (7, None)]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if r[1] != leak), key=str)


def test_items_without_an_id_count_as_one_item(spark):
    import duckdb
    import pandas as pd

    docs = [(1, "a b c end"), (2, "d e f and a b c"), (3, "one two"), (4, "clean")]
    items = [(None, "a b c"), (None, "d e f"), (7, "one two"), (7, "a b c"), (None, None)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    db.register("benchmark", pd.DataFrame({"item_id": pd.array([i for i, _ in items], "Int64"), "text": [t for _, t in items]}))
    got = decontaminate.contamination(*frames)
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(decontaminate.SQL).fetchall())
    assert [r.doc_id for r in decontaminate.drop_contaminated(*frames).collect()] == [4]


def test_contamination_without_items_or_documents(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.contamination(awkward(spark), items).collect()} == {False}
    assert decontaminate.contamination(empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_long_items_are_cut_without_losing_windows(spark):
    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(57)))], "item_id long, text string")
    pieces = decontaminate.item_pieces(items, 10, 7).collect()
    windows = {tuple(p.body.split()[i : i + 10]) for p in pieces for i in range(len(p.body.split()) - 9)}
    assert len(pieces) > 1 and len(windows) == 48


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = awkward_rows() + [(800, "a <|endoftext|>  b<|endoftext|>"), (801, "it's  we'll '' 's\r\n\t x²½ \u2003 ٣"), (802, "<|endoftext|")]
    frame = spark.createDataFrame([(r[0], r[1], 1, "clash", 2) for r in rows], "doc_id long, text string, block int, piece string, n_tokens int").repartition(3)
    want = sorted(((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=str)
    for pieces in (6_000_000, 900):
        assert sorted(map(tuple, token_counts.token_counts(frame, block_pieces=pieces).collect()), key=str) == want
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_language_model_counts_and_likelihood(spark):
    rows = awkward_rows()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts, docs = Counter(), 0
    for r in rows:
        if not held(r[0]):
            counts.update(tokens(r[1]))
            docs += 1
    n, v = sum(counts.values()) + docs, len(counts) + 1
    want = []
    for r in rows:
        w = tokens(r[1])
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((docs + 0.1) / (n + 0.1 * (v + 1)))
        want.append((r[0], held(r[0]), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(base, 6)))
    for tokens_a_block in (4_000_000, 500):
        got = hidden_markov.language_model_scores(awkward(spark).repartition(3), rounds=3, block_tokens=tokens_a_block).collect()
        assert sorted(((*tuple(r)[:5], round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
        long = [r for r in got if r.n_tokens > 20]
        assert sum(r.score for r in long) > sum(r.base_score for r in long)
    assert hidden_markov.language_model_scores(empty(spark)).count() == 0


def plain_forward(model, seq):
    alpha, total = model.start * model.emit[seq[0]], 0.0
    for c in seq[1:]:
        alpha = (alpha @ model.move) * model.emit[c]
    return math.log(alpha.sum())


def test_forward_recursion_and_baum_welch_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    k, c = 2, 4
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hidden_markov.HiddenMarkov(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((c, k)), 0))
    sizes = np.array([3, 1, 5, 2, 7])
    flat = rng.integers(0, c, sizes.sum())
    seqs = np.split(flat, np.cumsum(sizes)[:-1])
    assert np.allclose(hidden_markov.forward(model, flat, sizes), [plain_forward(model, s) for s in seqs])
    emits, moves, first = np.zeros((c, k)), np.zeros((k, k)), np.zeros(k)
    for s in seqs:
        paths = {p: model.start[p[0]] * math.prod(model.emit[o, q] for o, q in zip(s, p)) * math.prod(model.move[a, b] for a, b in zip(p, p[1:])) for p in product(range(k), repeat=len(s))}
        for p, w in paths.items():
            w /= sum(paths.values())
            first[p[0]] += w
            for o, q in zip(s, p):
                emits[o, q] += w
            for a, b in zip(p, p[1:]):
                moves[a, b] += w
    # Cuts into segments, and batches of segments, change nothing.
    for segment, most in ((512, 1000), (2, 1000), (1, 1000), (3, 4), (1, 1)):
        got = hidden_markov.expected_counts(model, flat, sizes, segment, most)
        assert np.allclose(got[0], emits) and np.allclose(got[1], moves) and np.allclose(got[2], first)
        assert np.isclose(got[3], sum(plain_forward(model, s) for s in seqs))


def test_scores_by_a_plain_recursion_over_raw_tokens(spark):
    rows = [r for r in awkward_rows() if len(r[1] or "") < 20_000]
    docs = spark.createDataFrame([(*r[:2], "x", 1.0) for r in rows], "doc_id long, text string, held string, score double").repartition(3)
    options = dict(rounds=2, head_share=0.01, block_tokens=700)
    _, classes, model = hidden_markov.fit(docs, **options)
    counts = Counter()
    words = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))]
    for r in rows:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10:
            counts.update(words(r[1]))
    of_ending = {}
    for w, n in counts.items():
        if w not in classes.heads:
            of_ending.setdefault(hidden_markov.ending(w), []).append(n)
    assert classes.heads and of_ending

    def plain(text):
        alpha, total = model.start, 0.0
        seq = [*words(text), None]
        for t, w in enumerate(seq):
            inside, number = 1.0, len(model.emit) - 1
            if w is not None:
                number = classes.heads.get(w)
                if number is None:
                    same = of_ending.get(hidden_markov.ending(w), [])
                    number = len(classes.heads) + hidden_markov.ending(w)
                    inside = (counts[w] + 0.1) / (sum(same) + 0.1 * (len(same) + 1))
            alpha = (alpha if t == 0 else alpha @ model.move) * model.emit[number]
            total += math.log10(alpha.sum() * inside)
            alpha = alpha / alpha.sum()
        return total

    got = sorted(((r.doc_id, round(r.score, 5)) for r in hidden_markov.language_model_scores(docs, **options).collect()), key=str)
    assert got == sorted(((r[0], round(plain(r[1]), 5)) for r in rows), key=str)


def test_rounds_raise_the_likelihood(spark):
    coded, classes = hidden_markov.code_documents(awkward(spark))
    model, seen = hidden_markov.first_model(classes.totals()), []
    for _ in range(4):
        model, likelihood = hidden_markov.train_round(coded, model)
        seen.append(likelihood)
    assert seen == sorted(seen) and np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)


@pytest.mark.parametrize("domain", [1, 2, 3, 17, 1000, 4097])
def test_feistel_permutes(domain):
    out = token_shards.feistel(np.arange(domain), domain)
    assert sorted(out.tolist()) == list(range(domain))
    if domain > 10:
        assert out.tolist() != token_shards.feistel(np.arange(domain), domain, key=5).tolist() != list(range(domain))


def scalar_feistel(x, domain, key):
    return int(token_shards.feistel(np.array([x]), domain, key)[0])


def plain_shards(spark, rows, length, blocks, key=token_shards.KEY):
    """Records by slot: (first_doc, first_token, ids, doc_ids, doc_tokens)."""
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.encode_special_tokens = True
    frame = spark.createDataFrame([(r[0], r[1] or "") for r in rows], "doc_id long, text string")
    hashed = frame.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", F.lit(key)), F.lit(blocks)).alias("block")).collect()
    found = []
    for block in range(blocks):
        stream = []
        mine = [r for r in hashed if r.block == block]
        for r in sorted(mine, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text.encode())):
            ids = library.encode(r.text, add_special_tokens=False).ids + [50256]
            stream += [(r.doc_id, k, t) for k, t in enumerate(ids)]
        found += [stream[i : i + length] for i in range(0, len(stream), length)]
    out = {}
    for number, part in enumerate(found):
        docs_in = []
        for doc_id, k, _ in part:
            if not docs_in or k == 0:
                docs_in.append([doc_id, 0])
            docs_in[-1][1] += 1
        first = part[0]
        out[scalar_feistel(number, len(found), key)] = (-1 if first[0] is None else first[0], first[1], [t for *_, t in part], [d for d, _ in docs_in], [n for _, n in docs_in])
    return out


def test_shards_by_brute_force_at_any_number_of_tasks(spark):
    rows = awkward_rows(n=25) + [(800, "a <|endoftext|> b"), (801, "x " * 700)]
    rows = [(*r, "clash", 1)[:2] + ("clash", 1) for r in rows]
    total = sum(len((r[1] or "").encode()) for r in rows)
    want = plain_shards(spark, rows, 64, -(-total // 20_000))
    assert sorted(want) == list(range(len(want))) and total > 60_000
    seen = set()
    for tasks in (1, 4, 9):
        frame = spark.createDataFrame(rows, "doc_id long, text string, slot string, block int").repartition(tasks)
        path = new_path(spark, "test-shards")
        token_shards.write_shards(frame, path, length=64, shard_bytes=(5000, 5000), block_bytes=20_000)
        about = spark.read.parquet(f"{path}/about").first()
        stride = 16 + 2 * 64 + 1
        assert about.records == len(want) and about.per_shard == 5000 // stride and about.end_token == 50256
        got = {r.slot: r for r in token_shards.read_from(spark, path).collect()}
        assert {s: (r.first_doc_id, r.first_token, np.frombuffer(r.ids, "<u2").tolist()) for s, r in got.items()} == {s: w[:3] for s, w in want.items()}
        assert all((r.shard, r.byte_offset) == (s // about.per_shard, s % about.per_shard * stride) for s, r in got.items())
        listed = {r.slot: (r.doc_ids, r.doc_tokens) for r in token_shards.shard_report(spark, path).collect()}
        assert listed == {s: w[3:] for s, w in want.items()}
        files = spark.read.format("binaryFile").load(f"{path}/records").select("path", "length").orderBy("path").collect()
        assert [f.length for f in files if f.length][:-1] == [about.per_shard * stride] * (len(want) // about.per_shard - (len(want) % about.per_shard == 0))
        seen.add(tuple(r.ids for _, r in sorted(got.items())))
        # Resume anywhere: straight from the file, and through the reader.
        for slot in (0, about.per_shard - 1, about.per_shard, len(want) - 1):
            with open(files[slot // about.per_shard].path.removeprefix("file:"), "rb") as f:
                f.seek(slot % about.per_shard * stride)
                record = np.frombuffer(f.read(stride), np.dtype([*token_shards.record_dtype(64, "<u2").descr, ("end", "u1")]))[0]
            assert record["ids"][: record["n_tokens"]].tolist() == want[slot][2]
            again = token_shards.read_from(spark, path, slot, 3).collect()
            assert sorted(r.slot for r in again) == list(range(slot, min(slot + 3, len(want))))
        assert token_shards.read_from(spark, path, len(want)).count() == 0
    assert len(seen) == 1


def test_ids_of_large_vocabularies_take_four_bytes():
    assert token_shards.id_type(50256) == "<u2" and token_shards.id_type(65535) == "<u2" and token_shards.id_type(65536) == "<u4"
    assert token_shards.end_token(token_shards.load_vocabulary("byte_bpe_50k.tiktoken")) == 50256


def test_shards_of_an_empty_table(spark):
    path = new_path(spark, "test-shards")
    token_shards.write_shards(empty(spark), path)
    assert token_shards.read_from(spark, path).count() == 0 and token_shards.shard_report(spark, path).count() == 0
