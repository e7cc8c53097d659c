"""Identity of an evaluation dataset: a digest that changes with any path, text or gold case.

Every value is delimited by its length.  Rows are folded in a fixed order by
buckets of their key's hash, so no task and no driver holds the whole list; the
digest of the buckets is the identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "dataset-1"
#: Hexadecimal digits of a key's hash that name its bucket: 65,536 buckets.
DIGITS = 4


def delimited(*values: Column) -> Column:
    """Values one after the other, each with its length in bytes before it; null counts as empty."""
    each = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return F.concat(*[F.concat(F.octet_length(v).cast("string"), F.lit(":"), v) for v in each])


def rows_digest(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    """``(digest)``: one row, the digest of all (key, SHA-256 of value) in order of the key."""
    each = rows.select(F.coalesce(key.cast("string"), F.lit("")).alias("k"), F.sha2(F.coalesce(value.cast("string"), F.lit("")).cast("binary"), 256).alias("v"))
    each = each.select(F.substring(F.sha2(F.col("k").cast("binary"), 256), 1, DIGITS).alias("bucket"), delimited(F.col("k"), F.col("v")).alias("item"))
    folded = each.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("item")), "").cast("binary"), 256).alias("d"))
    return folded.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", "d"))), "").cast("binary"), 256).alias("digest"))


def dataset_identity(documents: DataFrame, gold: DataFrame) -> DataFrame:
    """``(identity)`` of ``documents (source_path, text)`` and ``gold (key, value)``."""
    corpus = rows_digest(documents, F.col("source_path"), F.col("text")).select(F.col("digest").alias("corpus"))
    cases = rows_digest(gold, F.col("key"), F.col("value")).select(F.col("digest").alias("cases"))
    # One row meets one row.
    both = corpus.withColumn("one", F.lit(1)).join(cases.withColumn("one", F.lit(1)), "one")
    return both.select(F.sha2(delimited(F.lit(VERSION), F.col("corpus"), F.col("cases")).cast("binary"), 256).alias("identity"))
