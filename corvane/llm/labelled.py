"""Labelled documents for the classifiers: folds and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
TRAIN_ROWS = 20_000


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id counts as an empty text and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text, label)`` of about ``most`` labelled rows at most that are not held out.

    Rows are chosen by a hash of the id, so the sample does not depend on
    their order; ids whose labels disagree or are null are left out.
    """
    one = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    one = one.groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
    one = one.where("label = other").select("label_id", "label")
    total = one.count()
    if total > most:
        share = F.pmod(F.xxhash64(F.col("label_id"), F.lit(label)), F.lit(1_000_003)) / F.lit(1_000_003.0)
        one = one.where(share < most / total)
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).alias("text"))
    return texts.join(one, "label_id").select("text", "label")
