"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes, words and lines of the whole text.  Trees are
grown on binned values of a bounded labelled sample, then flattened into
arrays that numpy traverses for a batch of documents at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.labelled import TRAIN_ROWS, held_out, training_sample

BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
THRESHOLD = 0.3
STATISTICS = (
    "bytes", "words", "mean_word", "distinct_words", "top_word", "repeats", "upper", "digit", "punctuation", "symbol",
    "bang", "pipe", "comma", "stop", "white", "non_ascii", "lines", "distinct_lines", "mean_line", "longest_word",
    "one_letter", "title_words", "symbol_words", "entropy",
)
_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_SYMBOL = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
_WHITE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)


def statistics(text: bytes | None) -> list[float]:
    """The figures of ``STATISTICS`` for one text in UTF-8."""
    text = text or b""
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if size else np.zeros(256, np.int64)
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(words)
    share = lambda which: float(counts[which].sum()) / max(size, 1)
    p = counts[counts > 0] / max(size, 1)
    distinct = list(seen)
    lengths = np.fromiter(map(len, distinct), np.int64, len(distinct))
    times = np.fromiter(seen.values(), np.int64, len(distinct))
    total = max(n, 1)
    return [
        float(np.log1p(size)), float(np.log1p(n)), float((lengths * times).sum()) / total, len(seen) / total,
        float(times.max(initial=0)) / total, sum(map(bytes.__eq__, words, words[1:])) / total,
        share(_UPPER), share(_DIGIT), share(_PUNCTUATION), share(_SYMBOL), share(33), share(124), share(44), share(46), share(_WHITE),
        float(counts[128:].sum()) / max(size, 1), float(np.log1p(len(lines))), len(set(lines)) / max(len(lines), 1),
        float(np.log1p(n / max(len(lines), 1))), float(lengths.max(initial=0)),
        float(times[lengths == 1].sum()) / total, sum(map(bytes.istitle, words)) / total,
        sum(t for w, t in seen.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,") / total,
        float(-(p * np.log2(p)).sum()) if size else 0.0,
    ]


@dataclass
class BoostedTrees:
    """Flattened trees; node i of a tree has the children 2 i + 1 and 2 i + 2.

    ``feature`` is -1 at a leaf; ``cut`` sends values up to it to the left.
    """

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        margin = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.feature.shape[1].bit_length() - 1 if self.feature.ndim == 2 else 0
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                f = feature[node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            margin += value[node]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = 1.0, least: float = 2.0) -> BoostedTrees:
    """Histogram gradient boosting with the logistic loss."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(edges[k], x[:, k], "left") for k in range(width)], axis=1)
    offsets = np.arange(width) * bins
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    nodes = 2 ** (depth + 1) - 1
    feature, cut, value = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        members = {0: np.arange(n)}
        for node in range(nodes):
            own = members.pop(node, None)
            if own is None:
                continue
            sum_g, sum_h = g[own].sum(), h[own].sum()
            value[t, node] = rate * sum_g / (sum_h + ridge)
            if 2 * node + 2 >= nodes or len(own) < 2 * least:
                margin[own] += value[t, node]
                continue
            at = (binned[own] + offsets).ravel()
            hist_g = np.bincount(at, np.repeat(g[own], width), width * bins).reshape(width, bins)
            hist_h = np.bincount(at, np.repeat(h[own], width), width * bins).reshape(width, bins)
            hist_n = np.bincount(at, minlength=width * bins).reshape(width, bins)
            left_g, left_h, left_n = hist_g.cumsum(1), hist_h.cumsum(1), hist_n.cumsum(1)
            gain = left_g**2 / (left_h + ridge) + (sum_g - left_g) ** 2 / (sum_h - left_h + ridge) - sum_g**2 / (sum_h + ridge)
            gain[(left_n < least) | (len(own) - left_n < least)] = -1
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                margin[own] += value[t, node]
                continue
            feature[t, node], cut[t, node] = f, edges[f][b]
            goes_left = binned[own, f] <= b
            members[2 * node + 1], members[2 * node + 2] = own[goes_left], own[~goes_left]
    return BoostedTrees(base, feature, cut, value)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, **columns) -> BoostedTrees | None:
    """Trees from about ``most_rows`` labelled rows that are not held out; only their statistics reach the driver."""
    sample = training_sample(docs, labels, "quality", most_rows, **columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["label", "figures"])

    rows = sample.select(F.col("text").cast("binary"), "label").mapInArrow(run, "label int, figures array<double>").toArrow()
    if not rows.num_rows:
        return None
    x = np.array(rows.column("figures").to_pylist())
    y = rows.column("label").to_numpy().astype(float)
    order = np.lexsort((y, *x.T))  # the trees do not depend on the order in which rows arrive
    return grow(x[order], y[order])


def quality(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null text is scored as empty, long texts as a whole; a null id is held out;
    without training rows every score is 0.5; rows that repeat, or share an id,
    are scored each by its text; other columns are not read; an empty table
    gives an empty result.
    """
    model = fit(docs, labels, most_rows, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(STATISTICS))
            found = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
