"""An extension: documents that arrive as a stream are folded into an index table.

Each micro-batch replaces the chunks of the sources it brings, by one segment
of the store; the latest version of a source in a batch wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.chunking import chunk_documents
from corvane.operators.embedding import embed_column
from corvane.operators.store import ParquetStore
from corvane.sources.shared import scratch, staged


def fold_batch(store: ParquetStore, batch: DataFrame, strategy: str = "markdown", size: int = 800, overlap: int = 120) -> None:
    """Replace the sources of one batch ``(source_path, text, seen_at)``."""
    spark = batch.sparkSession
    newest = batch.withColumn("nth", F.row_number().over(Window.partitionBy("source_path").orderBy(F.desc("seen_at")))).where("nth = 1")
    with scratch(spark):
        newest = staged(newest.select("source_path", "text"), "batch")
        chunks = staged(chunk_documents(newest, strategy, size, overlap).withColumn("embedding", embed_column(F.col("text"))), "batch-chunks")
        store.apply(chunks, newest.select("source_path"))


def stream_into_index(documents: DataFrame, store: ParquetStore, checkpoint: str, **options) -> StreamingQuery:
    """Start folding a streaming frame ``(source_path, text, seen_at)``; batches may repeat after a failure, with the same result."""
    return documents.writeStream.foreachBatch(lambda batch, _: fold_batch(store, batch, **options)).option("checkpointLocation", checkpoint).start()
