"""Pieces of Arrow batches, terms of their texts, and the best rows of queries: what Arrow functions inside tasks share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A batch of Spark has up to 10,000 rows and 64 MB; functions work on pieces of it.
PIECE_ROWS, PIECE_BYTES = 16_384, 8 << 20
#: Scores are compared at so many decimals.
DIGITS = 9
#: Upper bounds may differ from the sums of the same scores by rounding.
SLACK = 10.0 ** (1 - DIGITS)
#: Scores of queries and rows that a search holds at once, places of postings that it looks up at once, and pairs that it gathers before it does.
CELLS, LOOKUPS, PAIRS = 1 << 20, 1 << 20, 1 << 17
#: A term takes part in the product of matrices where its pairs of queries and rows are at least one in so many of all, as
#: that many products of numbers take as long as one addition to a place; at most so many terms do.
SPARSE, COMMON = 512, 512
#: The same terms as those of :func:`corvane.functions.text.terms`, in bytes whose ASCII letters are lower-cased.
TERM = re.compile(rb"[a-z0-9_]+")


def pieces(batch: pa.RecordBatch, text: int, rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in order, cut to at most ``rows`` rows, and ``size`` bytes of the column ``text`` or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        fits = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right"))
        past = min(max(first + 1, fits), first + rows)
        yield batch.slice(first, past - first)
        first = past


def terms_of(column: pa.Array) -> Iterator[list[bytes]]:
    """The terms of each text of a column; null has none."""
    for text in column.cast(pa.large_binary()):
        raw = text.as_py()
        yield TERM.findall(raw.lower()) if raw else []


#: Bytes of terms in lower case, and 0 for all others.
_LOWER = np.array([ord(chr(b).lower()) if TERM.match(chr(b).lower().encode("latin-1")) and b < 128 else 0 for b in range(256)], np.uint8)
#: Masks of the first 0 to 8 bytes of a word of 8.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], "<u8")


class Words:
    """Known terms, found in the bytes of many texts at once.

    A term of at most 16 bytes is two numbers of 8 bytes, which are compared in
    full; a table of hashes says with which known ones.  Longer terms are looked
    up one by one.
    """

    def __init__(self, known: dict[bytes, int]):
        self.known, self.size = known, len(known)
        short = [t for t in known if len(t) <= 16]
        word = np.frombuffer(b"".join(t.ljust(16, b"\0") for t in short), "<u8").reshape(-1, 2)
        self.bits = max(4, len(short).bit_length() + 2)
        slot = self._slot(word[:, 0], word[:, 1])
        order = np.argsort(slot, kind="stable")
        self.first, self.second = word[order, 0], word[order, 1]
        self.number = np.array([known[t] for t in short], np.int64)[order]
        self.edge = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1))

    def _slot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first ^ (second * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many terms each text of a column has, null none, and the number of each term of all texts, -1 for one that is not known."""
        column = column.cast(pa.large_binary())
        column = column.fill_null(b"") if column.null_count else column
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        size = int(ends[-1] - ends[0])
        # Sixteen more bytes, so that a term at the end is read like the others.
        low = np.zeros(size + 16, np.uint8)
        if size:
            np.take(_LOWER, np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], out=low[:size])
        ends = ends - ends[0]
        there = low != 0
        begins, stops = there.copy(), there.copy()
        begins[1:] &= ~there[:-1]
        stops[:-1] &= ~there[1:]
        # A text begins and ends its terms.
        begins[ends[:-1]] = there[ends[:-1]]
        last = ends[1:][ends[1:] > 0] - 1
        stops[last] = there[last]
        begin = np.flatnonzero(begins)
        length = np.flatnonzero(stops) + 1 - begin
        number = np.full(len(begin), -1, np.int64)
        at = np.ndarray(size + 9, "<u8", low, strides=(1,))
        first, second = at[begin] & _FIRST[np.minimum(length, 8)], np.zeros(len(begin), np.uint64)
        longer = np.flatnonzero(length > 8)
        second[longer] = at[begin[longer] + 8] & _FIRST[np.minimum(length[longer] - 8, 8)]
        slot = self._slot(first, second)
        place, past = self.edge[slot], self.edge[slot + 1]
        left = np.flatnonzero((place < past) & (length <= 16))
        while len(left):
            same = (self.first[place[left]] == first[left]) & (self.second[place[left]] == second[left])
            number[left[same]] = self.number[place[left[same]]]
            left = left[~same]
            place[left] += 1
            left = left[place[left] < past[left]]
        for i in np.flatnonzero(length > 16).tolist():
            number[i] = self.known.get(low[begin[i] : begin[i] + length[i]].tobytes(), -1)
        return np.diff(np.searchsorted(begin, ends)), number


class Postings:
    """The rows of a piece that have each of some known terms, by term and row, with the terms' counts; and the length of every row's text."""

    def __init__(self, column: pa.Array, known: dict[bytes, int] | Words):
        known = known if isinstance(known, Words) else Words(known)
        self.rows = n = len(column)
        self.length, number = known.read(column)
        there = number >= 0
        self.key, self.count = np.unique((number * n + np.repeat(np.arange(n), self.length))[there], return_counts=True)
        self.row = self.key % max(n, 1)
        self.start = np.searchsorted(self.key, np.arange(known.size + 1) * max(n, 1))

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the postings of ``terms``, one term after the other, and how many each has."""
        often = self.start[terms + 1] - self.start[terms]
        return np.repeat(self.start[terms] - np.r_[0, np.cumsum(often)[:-1]], often) + np.arange(int(often.sum())) if len(terms) else np.zeros(0, np.int64), often


class Best:
    """The ``k`` best rows of each of ``n`` queries so far; equal scores go by position, a number or a string.

    ``floor``: for each query a score that its ``k`` best rows reach in any case, as ``k`` rows elsewhere do.
    """

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = max(k, 1)
        self.query, self.position, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        #: What a row needs at least: the k-th best score, while there are fewer the given one or 0.
        self.floor = np.zeros(n) if floor is None else floor.copy()

    def add(self, query: np.ndarray, position: np.ndarray, score: np.ndarray) -> None:
        query, position, score = (np.concatenate(x) for x in ((self.query, query), (self.position, position), (self.score, score)))
        rounded = np.round(score, DIGITS)
        order = np.lexsort((-rounded, query))
        # Positions may be strings, which are slow to compare: only those of equal scores are.
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (query[order][1:] != query[order][:-1]) | (rounded[order][1:] != rounded[order][:-1])
        tied = np.flatnonzero(~(new[:-1] & new[1:]))
        order[tied] = order[tied][np.lexsort((position[order[tied]], np.cumsum(new)[tied]))]
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        kept = nth < self.k
        self.query, self.position, self.score = query[kept], position[order][kept], score[order][kept]
        last = nth == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], rounded[order][last])

    def reaching(self, score: np.ndarray, first: int, share: float, slack: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) that may be among the best, of a block of scores in single precision of the queries from ``first`` on.

        A score is off by at most ``share`` of itself and ``slack``; those below ``least`` are left out.
        """
        n, floor = score.shape[1], self.floor[first : first + len(score)]
        low = np.maximum((floor - SLACK) * (1 - share) - slack, least).astype(np.float32)
        may = score >= low[:, None]
        many = np.flatnonzero(np.count_nonzero(may, axis=1) > 4 * self.k)
        if len(many):
            # So many rows of the piece reach their k-th best.
            kth = np.partition(score[many], n - self.k, axis=1)[:, n - self.k].astype(float)
            low[many] = np.maximum(low[many], (kth - slack) * (1 - share) ** 2 - SLACK - slack)
            may[many] = score[many] >= low[many, None]
        query, row = np.divmod(np.flatnonzero(may), n)
        return query + first, row


class Asked:
    """A block of ``n`` queries by term: ``query``, ``term`` and ``weight``, a row for each distinct term of a query."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int):
        self.query, self.term, self.weight, self.n = query, term, weight, n

    def weighed(self, weight: np.ndarray) -> Asked:
        return Asked(self.query, self.term, weight, self.n)

    @cached_property
    def by_query(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each query's rows begin, and the terms and weights in this order."""
        order = np.argsort(self.query, kind="stable")
        return np.searchsorted(self.query[order], np.arange(self.n + 1)), self.term[order], self.weight[order]

    @cached_property
    def often(self) -> np.ndarray:
        """How many queries have each term."""
        return np.bincount(self.term)

    @cached_property
    def share(self) -> float:
        """What share of itself a sum of single precision may be off by, as nothing is taken off in it."""
        return (COMMON + int(np.diff(self.by_query[0]).max(initial=0)) + 8) * float(np.finfo(np.float32).eps)

    def sums(self, found: Postings, impact: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The sums of weight and ``impact`` of each query's terms in the rows of a piece, queries by rows, in single precision.

        Some queries at once, from the first one given.  Terms that many
        queries and rows have are added by a product of matrices, the others
        posting by posting.
        """
        n = found.rows
        edge, term, weight = self.by_query
        here = np.diff(found.start)
        pairs = here[: len(self.often)] * self.often
        common = np.flatnonzero(pairs * SPARSE > self.n * n)
        common = common[np.argsort(-pairs[common], kind="stable")[:COMMON]]
        line = np.full(len(here), -1, np.int64)
        line[common] = np.arange(len(common))
        matrix = np.zeros((len(common), n), np.float32)
        at, times = found.of(common)
        matrix[np.repeat(np.arange(len(common)), times), found.row[at]] = impact[at]
        step = max(1, CELLS // max(n, 1))
        for a in range(0, self.n, step):
            z = min(a + step, self.n)
            own, of = term[edge[a] : edge[z]], np.repeat(np.arange(z - a), np.diff(edge[a : z + 1]))
            weights, lines = weight[edge[a] : edge[z]], line[own]
            dense = np.zeros((z - a, len(common)), np.float32)
            dense[of[lines >= 0], lines[lines >= 0]] = weights[lines >= 0]
            score = dense @ matrix
            rare = np.flatnonzero((lines < 0) & (here[own] > 0))
            at, times = found.of(own[rare])
            np.add.at(score.reshape(-1), np.repeat(of[rare] * n, times) + found.row[at], (np.repeat(weights[rare], times) * impact[at]).astype(np.float32))
            yield a, score

    def search(self, found: Postings, impact: np.ndarray, position: np.ndarray, best: Best) -> None:
        """Put the rows of a piece, scored by the sums of weight and ``impact`` of their terms, into ``best``; both are above 0.

        Sums of single precision tell which rows may be among the best; these are summed exactly.
        """
        if not len(found.key):
            return
        least = float(np.finfo(np.float32).tiny)
        for query, row in gathered(best.reaching(score, a, self.share, 0.0, least) for a, score in self.sums(found, impact)):
            score = self.exact(found, impact, query, row)
            good = score >= best.floor[query] - SLACK
            if good.any():
                best.add(query[good], position[row[good]], score[good])

    def exact(self, found: Postings, impact: np.ndarray, query: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The sums of weight and ``impact`` of the terms of pairs of a query and a row, each query's terms in their order."""
        edge, term, weight = self.by_query
        out, sizes = np.zeros(len(query)), edge[query + 1] - edge[query]
        ends, first = np.cumsum(sizes), 0
        while first < len(query) and len(found.key):
            before = int(ends[first - 1]) if first else 0
            past = max(first + 1, int(np.searchsorted(ends, before + LOOKUPS, "right")))
            size = sizes[first:past]
            at = np.arange(int(ends[past - 1]) - before) + np.repeat(edge[query[first:past]] - (ends[first:past] - size - before), size)
            want = term[at] * found.rows + np.repeat(row[first:past], size)
            place = np.minimum(np.searchsorted(found.key, want), len(found.key) - 1)
            out[first:past] = np.bincount(np.repeat(np.arange(past - first), size), np.where(found.key[place] == want, impact[place] * weight[at], 0.0), past - first)
            first = past
        return out


def gathered(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a query and a row, many parts put together; where there are very many pairs, some parts at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(query) for query, _ in held) > PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def growing(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Pieces of all batches; the first ones are small, so that floors stand before most rows come."""
    rows = PIECE_ROWS // 16
    for batch in batches:
        while batch.num_rows:
            piece = next(pieces(batch, text, rows))
            yield piece
            batch = batch.slice(piece.num_rows)
            rows = min(rows * 4, PIECE_ROWS)


def searching(asked: Asked, known: dict[bytes, int], k: int, impact: Callable[[Postings], np.ndarray], floor: np.ndarray | None = None):
    """An Arrow function over ``(position, text)``: the ``k`` best rows ``(number, position, score)`` of each query among those of a task, without those below ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, words = Best(asked.n, k, floor), Words(known)
        kind = pa.int64()
        for piece in growing(batches, 1):
            found, kind = Postings(piece.column(1), words), piece.column(0).type
            asked.search(found, impact(found), piece.column(0).to_numpy(zero_copy_only=False), best)
        if len(best.query):
            yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.position).cast(kind), pa.array(best.score)], ["number", "position", "score"])

    return run
