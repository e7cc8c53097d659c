"""Names and joins for tables of any shape; staging itself is the core's."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvane.sources.shared import discard, new_path, owned, release, scratch, staged

__all__ = ["BROADCAST_ROWS", "discard", "fresh", "join_side", "new_path", "owned", "quoted", "release", "scratch", "staged"]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(df: DataFrame) -> list[str]:
    """The columns of ``df`` for a select, whatever characters they have."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


#: Rows of a side that Spark may choose to broadcast; about 100 bytes each in memory.
BROADCAST_ROWS = 200_000


def join_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as one side of a join, of ``rows`` rows at most: beyond the bound Spark must not broadcast it.

    Parquet files of ids are many times smaller than their rows in memory, so
    Spark's own estimate would let a side through that the driver cannot hold.
    """
    return df.hint("merge") if rows > BROADCAST_ROWS else df
