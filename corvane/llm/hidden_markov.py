"""A hidden Markov language model over word classes.

A word's emission is P(class | state) P(word | class): words of at least a
fixed share of all training tokens are classes of their own, so there is a
bounded number of them, and all other words fall into classes by their ending.
Word counts are exact and cover the whole training corpus; they meet in one
shuffle and go back to the documents block by block.  Baum-Welch: every task
runs the scaled forward-backward recursion over its whole documents, and the
expected counts are summed by Spark, a row per class.  Long documents are cut
into segments that numpy handles side by side; what flows across a cut, forward
and backward, is carried exactly by the segments' transfer matrices.  The
scaled forward recursion gives the exact likelihood of a document.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.block_dictionary import pack, unpack, values_of_block
from corvane.llm.staging import scratch, staged

STATES = 8
ROUNDS = 5
FOLDS = 10
ADD = 0.1
#: A word with this share of the training tokens is a class of its own, so there are 200,000 of them at most.
HEAD_SHARE = 5e-6
ENDINGS = 4096
BLOCK_TOKENS = 4_000_000
ROW_DOCS = 500
SEGMENT = 2048
BATCH_TOKENS = 1_000_000
SEED = 7
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_BLOCK_SCHEMA = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary, words array<binary>, counts binary, train_tokens long, train_docs long"
_COUNT_SCHEMA = "block long, places binary, found binary, ending int, total long, distinct long, word binary"
_CODED_SCHEMA = "doc_ids array<long>, held array<boolean>, sizes array<int>, n_known array<int>, base array<double>, inner array<double>, classes binary"


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.translate(_LOWER).split() if text else []


def ending(word: bytes) -> int:
    """Class of a word by its last bytes and the punctuation after them."""
    stem = word.rstrip(b".,;:!?\"')")
    return zlib.crc32(stem[-3:] + b"|" + word[len(stem) : len(stem) + 1]) % ENDINGS


def token_blocks(docs: DataFrame, folds: int = FOLDS, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as numbers of their block's words; the block's last row has its words and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        numbers: dict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        counts = np.zeros(1024, np.int64)
        seen = 0
        held_docs: list[tuple] = []
        ids: list[np.ndarray] = []

        def close(last: bool) -> pa.RecordBatch:
            nonlocal counts
            doc_ids, held, sizes = zip(*held_docs)
            train = [not h for h in held]
            flat = np.concatenate(ids)
            new = np.bincount(flat[np.repeat(train, sizes)], minlength=len(numbers))
            if len(counts) < len(new):
                counts = np.r_[counts, np.zeros(max(len(new), 2 * len(counts)) - len(counts), np.int64)]
            counts[: len(new)] += new
            row = [
                pa.array([block], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([pack(flat)], pa.binary()),
                pa.array([list(numbers) if last else None], pa.list_(pa.binary())),
                pa.array([pack(counts[: len(numbers)]) if last else None], pa.binary()),
                pa.array([int(new.sum())], pa.int64()),
                pa.array([sum(train)], pa.int64()),
            ]
            held_docs.clear(), ids.clear()
            return pa.RecordBatch.from_arrays(row, ["block", "doc_ids", "held", "sizes", "ids", "words", "counts", "train_tokens", "train_docs"])

        for batch in batches:
            texts = batch.column(2)
            for k, (doc_id, held) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if len(held_docs) >= ROW_DOCS or seen >= block_tokens:
                    yield close(last=seen >= block_tokens)
                    if seen >= block_tokens:
                        block += 1
                        numbers.clear()
                        counts[:] = 0
                        seen = 0
                found = tokens(texts[k].as_py())
                ids.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                held_docs.append((doc_id, held, len(found)))
                seen += len(found)
        if held_docs:
            yield close(last=True)

    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, _BLOCK_SCHEMA)


def word_counts(blocks: DataFrame, head_count: float) -> DataFrame:
    """Training counts of all words, back to the blocks and summed by ending.

    Three kinds of rows: (block, places, found) with the count of each of a
    block's words; (ending, total, distinct) over the words that are not heads;
    (word, total) of the heads.  Words arrive sorted, so a task holds one run
    and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        heads: list[tuple[bytes, int]] = []
        done: list[tuple[np.ndarray, ...]] = []
        size = 0
        carry: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        carried: bytes | None = None

        def settle(word: bytes, count: int) -> None:
            if count >= head_count:
                heads.append((word, count))
            elif count:
                e = ending(word)
                total[e] += count
                distinct[e] += 1

        def rows(**have) -> pa.RecordBatch:
            n = len(next(iter(have.values())))
            kinds = {"block": pa.int64(), "places": pa.binary(), "found": pa.binary(), "ending": pa.int32(), "total": pa.int64(), "distinct": pa.int64(), "word": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(have.get(k, [None] * n), t) for k, t in kinds.items()], list(kinds))

        def flush() -> pa.RecordBatch:
            block, place, count = (np.concatenate(x) for x in zip(*done))
            order = np.lexsort((place, block))
            block, place, count = block[order], place[order], count[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)]
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            return rows(block=block[cuts[:-1]], places=[pack(np.diff(place[i:j], prepend=0)) for i, j in spans], found=[pack(count[i:j]) for i, j in spans])

        def finish() -> None:
            nonlocal size
            block, place, count = carry
            c = int(count.sum())
            settle(carried, c)
            done.append((block, place, np.full(len(block), c)))
            size += len(block)

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(2).dictionary_encode()
            words = coded.dictionary.to_pylist()
            at = coded.indices.to_numpy().astype(np.int64)
            block, place, count = (batch.column(k).to_numpy().astype(np.int64) for k in (0, 1, 3))
            if carry is not None and words[0] != carried:
                finish()
                carry = None
            if carry is not None:
                n = len(carry[0])
                block, place, count = (np.concatenate(x) for x in zip(carry, (block, place, count)))
                at = np.r_[np.zeros(n, np.int64), at]
            sums = np.bincount(at, count, len(words)).astype(np.int64)
            cut = int(np.searchsorted(at, len(words) - 1))
            for w, c in zip(words[:-1], sums[:-1].tolist()):
                settle(w, c)
            done.append((block[:cut], place[:cut], sums[at[:cut]]))
            size += cut
            carry, carried = (block[cut:], place[cut:], count[cut:]), words[-1]
            if size >= 400_000:
                yield flush()
                done.clear()
                size = 0
        if carry is not None:
            finish()
        if size:
            yield flush()
        used = np.flatnonzero(distinct)
        if len(used):
            yield rows(ending=used.astype(np.int32), total=total[used], distinct=distinct[used])
        if heads:
            yield rows(word=[w for w, _ in heads], total=[c for _, c in heads])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words = batch.column(1)[r].values
                counts = unpack(batch.column(2)[r].as_py())
                for i in range(0, len(words), 50_000):
                    part = words[i : i + 50_000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[r].as_py())), pa.array(np.arange(i, i + n, dtype=np.int32)), part, pa.array(counts[i : i + n])], ["block", "place", "word", "count"])

    words = blocks.where("words IS NOT NULL").select("block", "words", "counts").mapInArrow(spread, "block long, place int, word binary, count long")
    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, _COUNT_SCHEMA)


@dataclass
class WordClasses:
    """Heads and endings with their counts; class numbers are heads, then endings, then the end of a document."""

    heads: dict[bytes, int]
    head_counts: np.ndarray
    ending_total: np.ndarray
    ending_distinct: np.ndarray
    train_tokens: int
    train_docs: int

    @property
    def size(self) -> int:
        return len(self.heads) + ENDINGS + 1

    @property
    def distinct(self) -> int:
        return len(self.heads) + int(self.ending_distinct.sum()) + (self.train_docs > 0)

    def totals(self) -> np.ndarray:
        """Training tokens per class."""
        return np.r_[self.head_counts, self.ending_total, self.train_docs].astype(float)


def _coded(classes: WordClasses):
    """Cogroup function: a block's documents with the counts of its words -> documents as class numbers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        listed = [w for w in left.column("words") if w.is_valid]
        words = listed[0].values.to_pylist() if listed else []
        count = values_of_block(right, len(words))
        n_heads = len(classes.heads)
        kind = np.fromiter((h if (h := classes.heads.get(w)) is not None else n_heads + ending(w) for w in words), np.int64, len(words))
        tail = kind >= n_heads
        inner = np.zeros(len(words))
        e = kind[tail] - n_heads
        inner[tail] = np.log10((count[tail] + ADD) / (classes.ending_total[e] + ADD * (classes.ending_distinct[e] + 1)))
        below = classes.train_tokens + ADD * (classes.distinct + 1)
        base = np.log10((count + ADD) / below)
        end_base, end_known = float(np.log10((classes.train_docs + ADD) / below)), int(classes.train_docs > 0)
        out: dict[str, list] = {k: [] for k in ("doc_ids", "held", "sizes", "n_known", "base", "inner", "classes")}
        for r in range(left.num_rows):
            sizes = np.array(left.column("sizes")[r].as_py(), np.int64)
            ids = unpack(left.column("ids")[r].as_py())
            ends = np.r_[0, np.cumsum(sizes)]
            summed = lambda x: np.add.reduceat(np.r_[x[ids], 0], ends[:-1]) * (sizes > 0)
            full = np.full(len(ids) + len(sizes), classes.size - 1)
            full[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = kind[ids]
            out["doc_ids"].append(left.column("doc_ids")[r].as_py())
            out["held"].append(left.column("held")[r].as_py())
            out["sizes"].append((sizes + 1).astype(np.int32))
            out["n_known"].append((summed((count > 0).astype(np.int64)) + end_known).astype(np.int32))
            out["base"].append(summed(base) + end_base)
            out["inner"].append(summed(inner))
            out["classes"].append(pack(full))
        kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return run


@dataclass
class HiddenMarkov:
    """Start and transition probabilities, and P(class | state) as a class by state table."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(totals: np.ndarray, states: int = STATES, seed: int = SEED) -> HiddenMarkov:
    """States that tend to stay, with emissions of the corpus shaken by a seeded factor per class and state."""
    shaken = (totals[:, None] + 0.5) * np.exp(np.random.default_rng(seed).normal(0, 1.0, (len(totals), states)))
    move = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    return HiddenMarkov(np.full(states, 1 / states), move / move.sum(1, keepdims=True), shaken / shaken.sum(0))


class _Packed:
    """Sequences laid out by time: at each time the sequences that go on, longest first."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        ordered = sizes[self.order]
        longest = int(ordered[0]) if len(ordered) else 0
        self.active = len(ordered) - np.searchsorted(ordered[::-1], np.arange(longest), "right")
        self.at = np.r_[0, np.cumsum(self.active)]
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        time = np.arange(len(flat)) - np.repeat(starts, sizes)
        self.seen = np.empty(len(flat), np.int64)
        self.seen[self.at[time] + np.repeat(rank, sizes)] = flat


def forward(model: HiddenMarkov, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each sequence, by the scaled recursion."""
    p = _Packed(flat, sizes)
    total = np.zeros(len(sizes))
    ones = np.ones(len(model.start))
    alpha = None
    for t, n in enumerate(p.active.tolist()):
        prior = np.broadcast_to(model.start, (n, len(ones))) if alpha is None else alpha[:n] @ model.move
        alpha = prior * model.emit[p.seen[p.at[t] : p.at[t] + n]]
        scale = alpha @ ones
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(sizes))
    out[p.order] = total
    return out


def transfers(model: HiddenMarkov, flat: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each segment a matrix, up to a factor: what the recursion makes of a state before it.

    The state before a segment that ``begins`` a document is the start
    distribution, which does not move.
    """
    p = _Packed(flat, sizes)
    k = len(model.start)
    out = np.empty((len(sizes), k, k))
    through = None
    for t, n in enumerate(p.active.tolist()):
        if through is None:
            through = np.where(begins[p.order][:n, None, None], np.eye(k), model.move)
        else:
            through = (through[:n].reshape(n * k, k) @ model.move).reshape(n, k, k)
        through = through * model.emit[p.seen[p.at[t] : p.at[t] + n]][:, None, :]
        through /= through.sum(axis=(1, 2), keepdims=True)
        stop = int(p.active[t + 1]) if t + 1 < len(p.active) else 0
        out[p.order[stop:n]] = through[stop:n]
    return out


def borders(model: HiddenMarkov, flat: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment the forward distribution before it, and the backward weights after it."""
    k = len(model.start)
    before, after = np.tile(model.start, (len(sizes), 1)), np.ones((len(sizes), k))
    follows = np.flatnonzero(~begins)
    if len(follows):
        part = np.zeros(len(sizes), bool)
        part[follows] = part[follows - 1] = True
        through = np.zeros((len(sizes), k, k))
        through[part] = transfers(model, flat[np.repeat(part, sizes)], sizes[part], begins[part])
        for s in follows.tolist():
            x = before[s - 1] @ through[s - 1]
            before[s] = x / x.sum()
        for s in follows[::-1].tolist():
            x = through[s] @ after[s]
            after[s - 1] = x / x.sum()
    return before, after


def segment_counts(model: HiddenMarkov, flat: np.ndarray, sizes: np.ndarray, begins: np.ndarray, prior: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of segments with what :func:`borders` says about their surroundings."""
    p = _Packed(flat, sizes)
    k = len(model.start)
    ones = np.ones(k)
    begins, prior, after = begins[p.order], prior[p.order], after[p.order]
    seen = model.emit[p.seen]
    alpha = np.empty((len(flat), k))
    scale = np.empty(len(flat))
    before = None
    for t, n in enumerate(p.active.tolist()):
        i = p.at[t]
        a = np.where(begins[:n, None], model.start, prior[:n] @ model.move) if before is None else before[:n] @ model.move
        a = a * seen[i : i + n]
        s = a @ ones
        a /= s[:, None]
        alpha[i : i + n], scale[i : i + n] = a, s
        before = a
    moves = np.zeros((k, k))
    beta, later = None, 0
    seen /= scale[:, None]
    for t in range(len(p.active) - 1, -1, -1):
        n, i = int(p.active[t]), p.at[t]
        b = np.empty((n, k))
        if beta is not None:
            weighted = beta * seen[p.at[t + 1] : p.at[t + 1] + later]
            moves += alpha[i : i + later].T @ weighted
            b[:later] = weighted @ model.move.T
        ends = after[later:n]
        b[later:] = ends / (alpha[i + later : i + n] * ends).sum(axis=1, keepdims=True)
        alpha[i : i + n] *= b
        beta, later = b, n
    if len(sizes):
        inner = ~begins
        moves += prior[inner].T @ (beta * seen[: len(sizes)])[inner]
    emits = np.stack([np.bincount(p.seen, alpha[:, s], len(model.emit)) for s in range(k)], axis=1)
    first = alpha[: len(sizes)][begins].sum(0) if len(sizes) else np.zeros(k)
    return emits, moves * model.move, first, float(np.log(scale).sum())


def expected_counts(model: HiddenMarkov, flat: np.ndarray, sizes: np.ndarray, segment: int = SEGMENT, most_tokens: int = BATCH_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of whole documents: emissions, moves, starts, and the log likelihood.

    Memory is bounded by ``most_tokens``, however long a document is.
    """
    cut, begins = _segments(sizes, segment)
    prior, after = borders(model, flat, cut, begins)
    ends = np.r_[0, np.cumsum(cut)]
    k = len(model.start)
    emits, moves, starts, likelihood = np.zeros((len(model.emit), k)), np.zeros((k, k)), np.zeros(k), 0.0
    i = 0
    while i < len(cut):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most_tokens, "right")) - 1)
        e, m, s, x = segment_counts(model, flat[ends[i] : ends[j]], cut[i:j], begins[i:j], prior[i:j], after[i:j])
        emits, moves, starts, likelihood = emits + e, moves + m, starts + s, likelihood + x
        i = j
    return emits, moves, starts, likelihood


def _segments(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the pieces of at most ``most`` tokens that sequences are cut into, and which begin a sequence."""
    parts = -(-sizes // most)
    out = np.full(int(parts.sum()), most)
    ends = np.cumsum(parts)
    out[ends - 1] = sizes - (parts - 1) * most
    begins = np.zeros(len(out), bool)
    begins[ends - parts] = True
    return out, begins


def _batches(batches: Iterator[pa.RecordBatch], train: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Coded documents in batches of about ``BATCH_TOKENS``: classes, lengths, rows."""
    flats, lengths, rows, size = [], [], [], 0
    for batch in batches:
        for r in range(batch.num_rows):
            row = batch.slice(r, 1)
            sizes = row.column("sizes")[0].values.to_numpy().astype(np.int64)
            flat = unpack(row.column("classes")[0].as_py())
            if train:
                used = ~np.array(row.column("held")[0].as_py())
                flat, sizes = flat[np.repeat(used, sizes)], sizes[used]
            flats.append(flat), lengths.append(sizes), rows.append(row)
            size += len(flat)
            if size >= BATCH_TOKENS:
                yield np.concatenate(flats), np.concatenate(lengths), rows
                flats, lengths, rows, size = [], [], [], 0
    if rows:
        yield np.concatenate(flats), np.concatenate(lengths), rows


def train_round(coded: DataFrame, model: HiddenMarkov, segment: int = SEGMENT) -> tuple[HiddenMarkov, float]:
    """One Baum-Welch round over all training documents; returns the next model and the log likelihood of this one."""
    k, size = len(model.start), len(model.emit)
    shared = coded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = HiddenMarkov(*shared.value)
        emits, moves, starts, likelihood = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k), 0.0
        for flat, sizes, _ in _batches(batches, train=True):
            e, m, s, x = expected_counts(model, flat, sizes, segment)
            emits, moves, starts, likelihood = emits + e, moves + m, starts + s, likelihood + x
        used = np.flatnonzero(emits.any(axis=1))
        table = np.concatenate([emits[used], moves, starts[None], np.full((1, k), likelihood)])
        row = np.r_[used, size + np.arange(k + 2)]
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), *(pa.array(np.ascontiguousarray(table[:, s])) for s in range(k))], ["row", *(f"s{s}" for s in range(k))])

    schema = "row int, " + ", ".join(f"s{s} double" for s in range(k))
    summed = coded.select("held", "sizes", "classes").mapInArrow(run, schema).groupBy("row").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).toArrow()
    shared.unpersist()
    table = np.zeros((size + k + 2, k))
    table[summed.column("row").to_numpy()] = np.stack([summed.column(f"s{s}").to_numpy() for s in range(k)], axis=1)
    emits, moves, starts, likelihood = table[:size], table[size : size + k], table[size + k], table[size + k + 1, 0]
    share = (emits.sum(1) + 0.5) / (emits.sum() + 0.5 * size)
    emit = emits + 2.0 * share[:, None] + 1e-3 / size
    moves, starts = moves + 0.5, starts + 0.5
    return HiddenMarkov(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0)), float(likelihood)


def code_documents(docs: DataFrame, folds: int = FOLDS, block_tokens: int = BLOCK_TOKENS, head_share: float = HEAD_SHARE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, WordClasses]:
    """Documents as class numbers with their base scores, and the classes; counts cover all training documents."""
    with scratch(docs.sparkSession):
        blocks = staged(token_blocks(docs, folds, block_tokens, id_col, text_col), "token-blocks")
        words, train_docs = blocks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("train_docs"), F.lit(0))).first()
        n = words + train_docs
        counted = staged(word_counts(blocks, max(head_share * n, 1)), "word-counts")
        heads = sorted(((-r.total, bytes(r.word)) for r in counted.where("word IS NOT NULL").select("word", "total").collect()))
        endings = counted.where("ending IS NOT NULL").groupBy("ending").agg(F.sum("total"), F.sum("distinct")).collect()
        total, distinct = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        for e, t, d in endings:
            total[e], distinct[e] = t, d
        classes = WordClasses({w: i for i, (_, w) in enumerate(heads)}, np.array([-c for c, _ in heads], np.int64), total, distinct, n, train_docs)
        found = counted.where("block IS NOT NULL").select("block", "places", "found")
        left = blocks.select("block", "doc_ids", "held", "sizes", "ids", "words")
        coded = left.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_coded(classes), _CODED_SCHEMA)
        return staged(coded, "coded", lasting=True), classes


def fit(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, folds: int = FOLDS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, head_share: float = HEAD_SHARE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, WordClasses, HiddenMarkov]:
    """Documents as class numbers, the classes, and the model after all rounds."""
    coded, classes = code_documents(docs, folds, block_tokens, head_share, id_col, text_col)
    model = first_model(classes.totals(), states, seed)
    for _ in range(rounds if classes.train_tokens else 0):
        model, _ = train_round(coded, model)
    return coded, classes, model


def scored(coded: DataFrame, classes: WordClasses, model: HiddenMarkov) -> DataFrame:
    """Documents of :func:`fit` with their scores; see :func:`language_model_scores`."""
    shared = coded.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = HiddenMarkov(*shared.value)
        for flat, sizes, rows in _batches(batches, train=False):
            score = forward(model, flat, sizes) / np.log(10)
            flats = {c: np.concatenate([r.column(c)[0].values.to_numpy(zero_copy_only=False) for r in rows]) for c in ("held", "n_known", "base", "inner")}
            ids = pa.concat_arrays([r.column("doc_ids")[0].values for r in rows])
            columns = [ids, pa.array(flats["held"]), pa.array(sizes), pa.array(flats["n_known"].astype(np.int64)), pa.array(flats["base"]), pa.array(score + flats["inner"])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = coded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(classes.train_tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def language_model_scores(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the id is no multiple of ``folds`` are the
    training corpus; a null id counts as an empty text there.  Scores are log10
    probabilities of all words and the end, over whole texts of any length.
    Null text counts as empty; without training documents all words are
    unknown; words of equal counts are ordered by their bytes; repeated rows
    are counted and scored on their own; other columns are not read; an empty
    table gives an empty result.
    """
    return scored(*fit(docs, **options))


def op3_language_model(spark, sf_dir: str) -> DataFrame:
    return language_model_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
