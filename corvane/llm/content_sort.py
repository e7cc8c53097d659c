"""Exact deduplication by sorting contents.

Spark samples splitters and deals the rows out by ranges of (first bytes, hash
of all bytes, id, row); each task sorts its range, on disk where needed, so
equal texts lie next to each other, and each row's whole text is compared with
its neighbour's.  The splitters hold the first bytes and a hash instead of
whole texts, which keeps the sample that the driver sees small.  Id and row
number are part of the range key, so one text with very many copies spans
several ranges, whatever their ids, and no task gets it whole.  Runs at the
edges of a range are joined with the runs next door by comparing their whole
texts again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.staging import BROADCAST_ROWS, staged

CHUNK = 50_000
PREFIX = 16
_FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("sha", pa.string()),
        ("part", pa.int32()),
        ("run", pa.int64()),
        ("run_max", pa.int64()),
        ("run_min", pa.int64()),
        ("run_size", pa.int64()),
        ("edge_text", pa.binary()),
        ("summary", pa.bool_()),
    ]
)
_RUN_SCHEMA = "doc_id long, sha string, part int, run long, run_max long, run_min long, run_size long, edge_text binary, summary boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range with their run of equal neighbours.

    Of a run only its text and at most ``CHUNK`` ids are held: a short one
    gives rows with its figures, of which one carries the text if the run may
    go on in another range; the rows of a long one leave without figures, and
    a summary row of its own with text and figures follows.
    """
    import hashlib

    part, first_key, key, run = None, None, None, -1
    text, sha, low, high, size = None, None, None, None, 0
    ids: list = []
    out: list[tuple] = []

    def close(edge: bool) -> None:
        nonlocal text
        if text is None:
            return
        if size > len(ids):
            out.extend((x, sha, part, run, None, None, None, None, False) for x in ids)
            out.append((None, sha, part, run, high, low, size, text, True))
        else:
            out.extend((x, sha, part, run, high, low, size, text if edge and k == 0 else None, False) for k, x in enumerate(ids))
        ids.clear()
        text = None

    def flush() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(out), CHUNK):
            columns = zip(*out[i : i + CHUNK])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)
        out.clear()

    for batch in batches:
        if part is None and batch.num_rows:
            part, first_key = batch.column(3)[0].as_py(), batch.column(1)[0].as_py()
        for doc_id, hashed, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if text is None or content != text:
                # Texts that share a hash may be the last of the range as well.
                close(edge=key == first_key or key == hashed)
                text, key, sha, run = content, hashed, hashlib.sha256(content).hexdigest(), run + 1
                low, high, size = None, None, 0
            ids.append(doc_id)
            size += 1
            if doc_id is not None:
                low = doc_id if low is None else min(low, doc_id)
                high = doc_id if high is None else max(high, doc_id)
            if len(ids) >= CHUNK:
                out.extend((x, sha, part, run, None, None, None, None, False) for x in ids)
                ids.clear()
            if len(out) >= CHUNK:
                yield from flush()
    close(edge=True)
    yield from flush()


def exact_duplicates(
    docs: DataFrame,
    keep: str = "min",
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest id stays, or with
    ``keep="max"`` the one with the largest.  Null text counts as empty.  Rows
    that repeat an id within a group are all marked as kept or dropped with
    their id; a null id never stays while the group has another.  Texts of any
    length are compared whole.  An empty table gives an empty result; other
    columns are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be min or max")
    content = F.coalesce(F.col(text_col), F.lit(""))
    content = (normalise(content) if normalise else content).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(content).alias("hashed"), content.alias("content"), F.monotonically_increasing_id().alias("row"))
    start = F.substring("content", 1, PREFIX)
    ranges = rows.repartitionByRange(start, "hashed", "doc_id", "row").drop("row").sortWithinPartitions(start, "hashed", "content", "doc_id")
    ranges = ranges.withColumn("part", F.spark_partition_id())
    runs = staged(ranges.mapInArrow(_runs, _RUN_SCHEMA), "content-runs")

    # A text goes on in the next range only if it has the last hash of one and the first of the next, so texts at the edges meet by content.
    edges = runs.where("edge_text IS NOT NULL").groupBy("edge_text").agg(
        F.collect_list(F.struct("part", "run")).alias("members"),
        F.max("run_max").alias("all_max"),
        F.min("run_min").alias("all_min"),
        F.sum("run_size").alias("all_size"),
        F.max("summary").alias("long"),
    )
    edges = edges.where((F.size("members") > 1) | F.col("long")).select(F.explode("members").alias("m"), "all_max", "all_min", "all_size")
    edges = staged(edges.select(F.col("m.part").alias("part"), F.col("m.run").alias("run"), "all_max", "all_min", "all_size"), "content-edges")
    # About two rows a range, and one for each long run.
    edges = F.broadcast(edges) if edges.count() <= BROADCAST_ROWS else edges.hint("merge")
    kept = F.coalesce(F.col(f"all_{keep}"), F.col(f"run_{keep}"))
    return runs.where("NOT summary").drop("edge_text", "summary").join(edges, ["part", "run"], "left").select(
        "doc_id",
        kept.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(kept).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
