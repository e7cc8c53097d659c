"""Chunk records from JSON lines: typed rows, and the reasons why others are none.

All lines are judged in one pass, as columns: nothing is cast that has another
type, so a number in quotes is no number here.  Where a rejected line stands in
its file is worked out by Spark too, from counts of lines per split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRINGS = ("chunk_id", "source_path", "title", "text")
INTEGERS = ("chunk_index", "start_char", "end_char")
METADATA = "struct<start:int,end:int,chunk_strategy:string,source_title:string,section_title:string,heading_level:int>"
NUMBER_LIST = r"^ARRAY<(BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))>$"


def _kind(record: Column, path: str) -> Column:
    """The type of a value as Spark names it, VOID for a JSON null, null where there is none."""
    return F.schema_of_variant(F.try_variant_get(record, path, "variant"))


def reasons(record: Column) -> Column:
    """Why a parsed line is no chunk record: an array in fixed order, empty for a good one."""
    found = [F.when(record.isNull(), F.lit("not_json"))]
    whole = _kind(record, "$")
    is_object = F.coalesce(whole.startswith("OBJECT<"), F.lit(False))
    found.append(F.when(record.isNotNull() & ~is_object, F.lit("not_an_object")))

    def among(test: Column, reason: str) -> None:
        found.append(F.when(is_object & F.coalesce(test, F.lit(False)), F.lit(reason)))

    for name, kind in (*((s, "STRING") for s in STRINGS), *((i, "BIGINT") for i in INTEGERS)):
        has = _kind(record, f"$.{name}")
        among(has.isNull(), f"missing:{name}")
        among(has != kind, f"type:{name}")
    number = {i: F.try_variant_get(record, f"$.{i}", "long") for i in INTEGERS}
    right = {i: _kind(record, f"$.{i}") == "BIGINT" for i in INTEGERS}
    for i in INTEGERS:
        among(right[i] & (number[i] > 2**31 - 1), f"range:{i}")
    for i in INTEGERS[:2]:
        among(right[i] & (number[i] < 0), f"negative:{i}")
    among(right["start_char"] & right["end_char"] & (number["end_char"] < number["start_char"]), "span_reversed")
    among(~_kind(record, "$.metadata").startswith("OBJECT<"), "metadata_not_object")
    vector = _kind(record, "$.embedding")
    is_list = vector.startswith("ARRAY<")
    among((vector != "VOID") & ~is_list, "embedding_not_list")
    items = F.try_variant_get(record, "$.embedding", "array<double>")
    # An array of numbers hides its nulls in its type.
    among(is_list & (vector != "ARRAY<VOID>") & ~(vector.rlike(NUMBER_LIST) & F.forall(items, lambda x: x.isNotNull())), "embedding_item")
    among((vector == "ARRAY<VOID>") & (F.size(F.try_variant_get(record, "$.embedding", "array<variant>")) > 0), "embedding_item")
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def judged(lines: DataFrame, json_col: str = "value") -> DataFrame:
    """``lines`` without blank ones, their other columns, ``record`` (null where rejected) and ``reasons``."""
    others = [c for c in lines.columns if c != json_col]
    parsed = lines.where(F.trim(json_col) != "").select(*others, F.try_parse_json(json_col).alias("parsed"))
    parsed = parsed.withColumn("reasons", reasons(F.col("parsed")))
    get = lambda name, kind: F.try_variant_get("parsed", f"$.{name}", kind).alias(name)
    metadata = F.struct(*[F.try_variant_get("parsed", f"$.metadata.{n}", k).alias(n) for n, k in (f.split(":") for f in METADATA[7:-1].split(","))]).alias("metadata")
    record = F.struct(*[get(s, "string") for s in STRINGS], *[get(i, "int") for i in INTEGERS], metadata, get("embedding", "array<double>"))
    return parsed.select(*others, F.when(F.size("reasons") == 0, record).alias("record"), "reasons")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, split, nth)``: the lines of text files, numbered from somewhere within each split."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"))


def line_numbers(lines: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen``, some rows of :func:`file_lines`, with ``line``, counted from 1 in each file.

    Lines are counted per split; sums over the splits of a file give where each
    begins, and only those few rows are joined.
    """
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "split", (before - F.col("first") + 1).alias("shift"))
    return chosen.join(starts, ["file", "split"]).withColumn("line", F.col("nth") + F.col("shift")).drop("shift")
