"""Embedding: a provider's vectors, or hash vectors as the offline fallback."""

from __future__ import annotations

import hashlib
import time
from array import array
from collections import defaultdict
from collections.abc import Callable, Sequence
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DIMENSIONS = 128
BYTES = 16
STEP = 17
#: Distinct texts that are sent to a provider before what came back is put down.
ROUND_TEXTS = 100_000


class EmbeddingProvider(Protocol):
    """Turns texts into vectors; must be picklable, as tasks call it."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def token_slots(tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and signs of tokens, a row each, from the first bytes of their SHA-256."""
    raw = np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest()[:BYTES] for t in tokens), np.uint8).reshape(-1, BYTES).astype(np.int64)
    return (raw + STEP * np.arange(BYTES)) % DIMENSIONS, 1 - 2 * (raw % 2)


#: Tokens whose slots are counted at once, and that are kept from one batch to the next.
BLOCK_TOKENS, MOST_TOKENS = 1 << 15, 1 << 18


class Tokens:
    """Tokens by number with their places in a vector, one for each slot and sign; begun anew once there are ``MOST_TOKENS``."""

    def __init__(self):
        self.number: defaultdict[str, int] = defaultdict(int)
        # A new token gets the next number.
        self.number.default_factory = self.number.__len__
        self.place = np.zeros((0, BYTES), np.uint8)

    def read(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the tokens of all texts, and where each text's begin and the last one's end."""
        if len(self.number) > MOST_TOKENS:
            self.__init__()
        ends, at = [0], array("q")
        for t in texts:
            at.extend(map(self.number.__getitem__, (t or "").lower().split()))
            ends.append(len(at))
        slots, signs = token_slots(list(islice(self.number, len(self.place), None)))
        self.place = np.concatenate([self.place, (slots + DIMENSIONS * (signs < 0)).astype(np.uint8)])
        return np.frombuffer(at, np.int64), np.array(ends)


def hash_vectors(texts: Sequence[str | None], tokens: Tokens | None = None) -> np.ndarray:
    """Unit hash vectors, a row each; blank texts give zeros.  A token is hashed once for as long as ``tokens`` has it, and counted with the tokens of many texts at once."""
    tokens = tokens or Tokens()
    at, ends = tokens.read(texts)
    # Whole numbers are counted and none are weighed.
    counts, first = np.zeros((len(texts), 2 * DIMENSIONS)), 0
    while first < len(texts):
        past = max(first + 1, int(np.searchsorted(ends, ends[first] + BLOCK_TOKENS, "right")) - 1)
        for a in range(int(ends[first]), int(ends[past]), BLOCK_TOKENS):
            z = min(a + BLOCK_TOKENS, int(ends[past]))
            row = np.searchsorted(ends[first : past + 1], np.arange(a, z), "right") - 1
            counts[first:past] += np.bincount((tokens.place[at[a:z]] + 2 * DIMENSIONS * row[:, None]).ravel(), minlength=2 * DIMENSIONS * (past - first)).reshape(past - first, -1)
        first = past
    out = counts[:, :DIMENSIONS] - counts[:, DIMENSIONS:]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


@F.pandas_udf(ArrayType(DoubleType()))
def hash_vector(texts: pd.Series) -> pd.Series:
    """:func:`hash_vectors` of a batch."""
    return pd.Series(list(hash_vectors(texts)))


def call_with_retry(call: Callable[[], list], retries: int, backoff_ms: int, transient: Callable[[Exception], bool]) -> tuple[list, int]:
    """The result of ``call`` and how often it was tried again; transient errors wait longer each time."""
    for attempt in range(retries + 1):
        try:
            return call(), attempt
        except Exception as error:
            if attempt == retries or not transient(error):
                raise
            time.sleep(backoff_ms * 2**attempt / 1000)
    raise AssertionError


def is_transient(error: Exception) -> bool:
    """The driver-side twin of :func:`corvane.functions.text.is_transient`."""
    from corvane.functions.text import TRANSIENT_STATUS, TRANSIENT_TYPES, TRANSIENT_WORDS

    return type(error).__name__ in TRANSIENT_TYPES or getattr(error, "status_code", None) in TRANSIENT_STATUS or any(w in str(error).lower() for w in TRANSIENT_WORDS)


def failure_reason(error: Exception, attempts: int, retries: int) -> str:
    """Stable text for why an embedding call fell back."""
    name = type(error).__name__
    if is_transient(error):
        return f"provider_transient_error:{name}:retry_exhausted:{attempts}:max_retries:{retries}"
    message = " ".join(str(error).split())
    message = f"{message[:240].rstrip()}..." if len(message) > 240 else message
    return f"provider_error:{name}" + (f":{message}" if message else "")


def embed_column(text: Column) -> Column:
    """Hash vectors of a text column."""
    return hash_vector(text)


def text_key(text: Column) -> Column:
    """What a text is known by: the SHA-256 of its bytes, null counting as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def journal_of(spark: SparkSession, journal: str) -> DataFrame:
    """``(key, vector)`` of the texts that a journal has, each once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(journal)
    schema = "key string, vector array<double>"
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(journal).dropDuplicates(["key"])


def embed(rows: DataFrame, provider: EmbeddingProvider | None = None, batch: int = 10, retries: int = 2, backoff_ms: int = 800, text_col: str = "text", journal: str | None = None, round_texts: int = ROUND_TEXTS) -> tuple[DataFrame, dict]:
    """``rows`` with ``embedding``, and the provider's status.

    Without a provider, or if any of its batches fails, all rows get hash
    vectors: a store never mixes the two kinds.  Each distinct text is sent
    once, however many rows have it.  With a ``journal``, a folder of the
    provider's own, texts that it has are not sent at all: finished batches are
    added to it round by round, ``round_texts`` texts a round, also when others
    fail, so a run that is tried again sends only what is missing.
    """
    fallback = rows.withColumn("embedding", embed_column(F.col(text_col)))
    if provider is None:
        return fallback, {"provider": "embedding", "mode": "fallback", "reason": "missing_api_key"}
    from corvane.sources.shared import new_path, owned, scratch, staged

    @F.pandas_udf("struct<vector:array<double>,tries:int,failed:string>")
    def live(texts: pd.Series) -> pd.DataFrame:
        out = []
        for i in range(0, len(texts), batch):
            part = texts.iloc[i : i + batch].fillna("").tolist()
            try:
                vectors, again = call_with_retry(lambda p=part: provider.embed(p), retries, backoff_ms, is_transient)
                wrong = len(vectors) != len(part)
                out += [(None if wrong else list(map(float, vectors[k])), again, f"embedding_count_mismatch:{len(vectors)}:{len(part)}" if wrong else None) for k in range(len(part))]
            except Exception as error:
                out += [(None, retries, failure_reason(error, retries + 1, retries))] * len(part)
        return pd.DataFrame(out, columns=["vector", "tries", "failed"])

    spark = rows.sparkSession
    journal = journal or owned(spark, new_path(spark, "vectors"))
    again, failed = 0, None
    with scratch(spark):
        # Copies of a text meet as one row before they are shuffled.
        texts = rows.select(text_key(F.col(text_col)).alias("key"), F.coalesce(text_col, F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
        wanted = staged(texts.join(journal_of(spark, journal).select("key"), "key", "left_anti"), "texts")
        rounds = max(1, -(-wanted.count() // round_texts))
        for k in range(rounds):
            part = wanted.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
            made = staged(part.select("key", live(F.col("text")).alias("e")), "embedded")
            reason, tries = made.agg(F.min("e.failed"), F.coalesce(F.sum("e.tries"), F.lit(0))).first()
            made.where("e.failed IS NULL").select("key", "e.vector").write.mode("append").parquet(journal)
            again, failed = again + tries, failed or reason
            if failed:
                break
    if failed:
        return fallback, {"provider": "embedding", "mode": "fallback", "reason": failed}
    # A text with a third of all rows is a skewed key, which adaptive execution splits on the side of the rows.
    vectors = journal_of(spark, journal).withColumnRenamed("vector", "embedding").hint("merge")
    sides = rows.alias("r").join(vectors.alias("v"), text_key(F.col(f"r.{text_col}")) == F.col("v.key"), "left")
    keyed = sides.select("r.*", "v.embedding")
    return keyed, {"provider": "embedding", "mode": "live", "reason": f"recovered_after_retry:{again}" if again else None}

