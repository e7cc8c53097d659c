"""Answers of a chat model, asked from tasks; whatever fails there falls back to an extractive answer."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.embedding import failure_reason
from corvane.sources.shared import staged

TASK = "Answer the question from the context alone, briefly, and cite sources inline by their ids, such as [S1]. Where the context does not suffice, say what is missing."
NO_OUTPUT = "empty_provider_output"


class ChatProvider(Protocol):
    """Completes a prompt; must be picklable, as tasks call it."""

    def complete(self, prompt: str) -> str: ...


def prompt(question: Column, context: Column) -> Column:
    """What a chat model is asked for one question."""
    return F.concat(F.lit(f"{TASK}\n\nQuestion:\n"), question, F.lit("\n\nContext:\n"), context)


def ask_column(provider: ChatProvider):
    """A column function: prompt -> struct (reply, failed); an error of the provider is a reason and not the job's."""

    @F.pandas_udf("struct<reply:string,failed:string>")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        out = []
        for text in prompts:
            try:
                reply = (provider.complete(text) or "").strip()
                out.append((reply or None, None if reply else NO_OUTPUT))
            except Exception as error:
                out.append((None, failure_reason(error, 1, 0)))
        return pd.DataFrame(out, columns=["reply", "failed"])

    return ask


def asked(rows: DataFrame, provider: ChatProvider, key: str = "query_id") -> DataFrame:
    """``rows (key, prompt)`` -> ``(key, reply, failed)``, written once so that no prompt is sent twice."""
    made = staged(rows.select(key, ask_column(provider)(F.col("prompt")).alias("r")), "replies")
    return made.select(key, F.col("r.reply").alias("reply"), F.col("r.failed").alias("failed"))
