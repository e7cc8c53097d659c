"""Periodic runs: stretches of words that repeat with one period at least three times.

In a run with smallest period q, the words q apart are equal over a stretch
("diagonal" of lag q) of at least max(24, 3q) - q words.  That is 16 words or
more for every q, and 2q or more from q = 8 on.  So k-grams of 16 words are the
seeds for lags up to 16, and k-grams of 32, 64, ... words those for lags up to
32, 64, ...: each is no longer than the stretch that a run guarantees, and no
shorter than the lag.  By the second property, the next occurrence of a seed
within a run lies exactly its smallest period ahead (were it nearer, the run
would have a smaller period), so pairs of neighbouring occurrences find every
run, and a document of one repeated word gives n pairs and not n squared.

A seed pair is extended along its diagonal in both directions; a table of the
furthest word covered on each lag suppresses the seeds inside an extension.
The k-grams of doubled length are numbered exactly, from the numbers of their
halves, and only k-grams that their document repeats go on to the next length,
so ordinary text ends after a few rounds.  All documents of a batch are
numbered at once; a task holds one batch, or one document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES = 24, 3
BATCH_WORDS = 500_000


def first_seed(least: int, times: int) -> int:
    """The largest power of two that every run's diagonal has room for, whatever its period.

    The seeds must also cover lags up to their own length, so that the next
    length, twice as long, only has lags to find that guarantee it.
    """
    k = 1
    while all(max(least, times * q) - q >= 2 * k for q in range(1, max(2 * k, least) + 1)):
        k *= 2
    return k


def _renumbered(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(number, place)`` of the keys that occur more than once."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count[number] > 1
    return number[again], at[again]


def _extended(words: np.ndarray, low: int, high: int, start: int, stop: int, lag: int) -> tuple[int, int]:
    """The longest stretch around [start, stop) within [low, high) whose words equal those ``lag`` later."""
    step = 64
    while stop + lag < high:
        n = min(step, high - lag - stop)
        same = words[stop : stop + n] == words[stop + lag : stop + lag + n]
        if not same.all():
            stop += int(np.argmin(same))
            break
        stop += n
        step *= 2
    step = 64
    while start > low:
        n = min(step, start - low)
        same = (words[start - n : start] == words[start - n + lag : start + lag])[::-1]
        if not same.all():
            start -= int(np.argmin(same))
            break
        start -= n
        step *= 2
    return start, stop


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int, int]]:
    """``(document, start, length, period)`` of all runs; document d has the word numbers ``words[bounds[d]:bounds[d + 1]]``.

    A run is a stretch with smallest period q of at least max(least, times * q)
    words that no neighbouring word extends; starts count from the document's
    first word.  Results are in order of document, start and period.
    """
    if least < 1 or times < 3:
        # With two repetitions a diagonal is only as long as its lag, and no seed fits all lags of a class.
        raise ValueError("runs of three repetitions and more")
    k0 = first_seed(least, times)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place = np.arange(len(words))
    number, place = _renumbered(doc * (int(words.max(initial=0)) + 1) + words, place)
    found: list[tuple[int, int, int, int]] = []
    k = 1
    while len(place):
        if k >= k0:
            order = np.lexsort((place, number))
            here, ahead = place[order][:-1], place[order][1:]
            lag = ahead - here
            pairs = (number[order][:-1] == number[order][1:]) & (lag <= k) & (lag > (k // 2 if k > k0 else 0))
            here, lag = here[pairs], lag[pairs]
            order = np.lexsort((here, lag))
            here, lag = here[order], lag[order]
            # Seeds side by side on one lag are one stretch already.
            heads = np.flatnonzero(np.r_[True, (np.diff(lag) != 0) | (np.diff(here) != 1)]) if len(here) else np.zeros(0, int)
            tails = np.r_[heads[1:], len(here)] - 1
            covered: dict[int, int] = {}
            for start, last, q in zip(here[heads].tolist(), here[tails[: len(heads)]].tolist(), lag[heads].tolist()):
                if last < covered.get(q, -1):
                    continue
                d = int(doc[start])
                low, high = int(bounds[d]), int(bounds[d + 1])
                start, stop = _extended(words, low, high, start, last + k, q)
                covered[q] = stop
                length = stop - start + q
                if length >= max(least, times * q):
                    found.append((d, start - low, length, q))
        # A k-gram of twice the length starts where two follow each other in one document.
        at = np.full(len(words), -1, np.int64)
        at[place] = number
        place = np.sort(place)
        place = place[place + k < len(words)]
        both = (at[place + k] >= 0) & (doc[place] == doc[np.minimum(place + k, len(words) - 1)])
        place = place[both]
        number, place = _renumbered(at[place] * (int(at.max(initial=0)) + 1) + at[place + k], place)
        k *= 2
    return sorted(found)


def planted(n: int, key: int) -> np.ndarray | None:
    """Which original word each of ``n`` words becomes, or None for no change: the test pattern of the query."""
    if key % 10 or not n:
        return None
    g = key // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def periodic_runs(
    docs: DataFrame,
    least: int = LEAST,
    times: int = TIMES,
    plant: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_words: int = BATCH_WORDS,
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: the runs of each whole text, and the text without their repetitions.

    ``runs`` is an array of (start, length, period) by start and period.
    ``collapsed`` has the words of the text joined by one space, without those
    that lie behind the first period of some run.  Words are what ASCII white
    space separates.  Null and empty texts have no words and no runs; a row
    without an id is treated as any other (and has nothing planted); repeated
    rows give a row each, an empty table an empty result, other columns are not
    read.  ``plant`` repeats parts of some texts by a rule on the id, so that
    runs of all periods are there to be found.
    """
    import zlib

    fields = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
            ("collapsed", pa.string()),
        ]
    )

    def judged(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
        words, known = flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()
        for d, doc_id in enumerate(ids if plant else ()):
            n = len(texts[d])
            moved = planted(n, zlib.crc32(str(doc_id).encode())) if doc_id is not None else None
            if moved is not None:
                words[bounds[d] : bounds[d + 1]] = words[bounds[d] + moved]
        runs: list[list[dict]] = [[] for _ in ids]
        dropped = np.zeros(len(words) + 1, np.int64)
        for d, start, length, period in find_runs(words, bounds, least, times):
            runs[d].append({"start": start, "length": length, "period": period})
            dropped[bounds[d] + start + period] += 1
            dropped[bounds[d] + start + length] -= 1
        kept = np.cumsum(dropped)[:-1] == 0
        collapsed = []
        for d in range(len(ids)):
            part = slice(bounds[d], bounds[d + 1])
            collapsed.append(b" ".join([known[w] for w in words[part][kept[part]].tolist()]))
        columns = [ids, np.diff(bounds).tolist(), runs, pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # Bytes are split at ASCII white space alone.
                own = (text.as_py() or b"").split()
                if texts and size + len(own) > batch_words:
                    yield judged(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(own)
                size += len(own)
        if ids:
            yield judged(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
    # The greatest length / period first, compared exactly: whole part, then the remainder by cross multiplication.
    better = "(a, b) -> CASE WHEN a.length * b.period <> b.length * a.period THEN IF(a.length * b.period > b.length * a.period, -1, 1) WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1) ELSE IF(a.period < b.period, -1, IF(a.period > b.period, 1, 0)) END"
    best = F.try_element_at(F.expr(f"array_sort(runs, {better})"), F.lit(1))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
