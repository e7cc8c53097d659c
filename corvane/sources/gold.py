"""Gold cases for evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.errors import DataFormatError

LISTS = ("expected_answer_keywords", "expected_source_paths", "expected_span_keywords", "expected_retrieval_keywords")
OLD_NAMES = {"expected_answer_keywords": "expected_keywords", "expected_source_paths": "expected_sources"}


def _list(raw: Column, key: str) -> Column:
    found = F.from_json(F.get_json_object(raw, f"$.{key}"), "array<string>")
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def gold_cases(lines: DataFrame, json_col: str = "value") -> DataFrame:
    """JSON lines -> question, the four lists and notes.

    Old key names count where the new ones are missing; empty strings are
    dropped; retrieval keywords default to the span keywords only where their
    key is missing, so an explicit null means none.
    """
    raw = F.col(json_col)
    keys = F.json_object_keys(raw)
    has = lambda key: F.array_contains(keys, key)
    columns = {}
    for name in LISTS:
        value = _list(raw, name)
        if name in OLD_NAMES:
            value = F.when(has(name), value).otherwise(_list(raw, OLD_NAMES[name]))
        columns[name] = value
    columns["expected_retrieval_keywords"] = F.when(has("expected_retrieval_keywords"), columns["expected_retrieval_keywords"]).otherwise(columns["expected_span_keywords"])
    others = [c for c in lines.columns if c != json_col]
    return lines.where(F.trim(raw) != "").select(*others, F.get_json_object(raw, "$.question").alias("question"), *[v.alias(k) for k, v in columns.items()], F.get_json_object(raw, "$.notes").alias("notes"))


def read_gold(spark, path: str) -> DataFrame:
    """Cases of a JSONL file, numbered in file order as ``query_id``; an empty or malformed file is refused with its line."""
    import json

    with open(path, encoding="utf-8") as f:
        lines = [(n, line) for n, line in enumerate(f, 1) if line.strip()]
    if not lines:
        raise DataFormatError(f"{path} holds no cases")
    for n, line in lines:
        try:
            case = json.loads(line)
        except ValueError as error:
            raise DataFormatError(f"{path}, line {n}: {error}") from None
        if not isinstance(case, dict) or not str(case.get("question") or "").strip():
            raise DataFormatError(f"{path}, line {n}: a case needs a question")
    return gold_cases(spark.createDataFrame([(i, line) for i, (_, line) in enumerate(lines)], "query_id long, value string"))
