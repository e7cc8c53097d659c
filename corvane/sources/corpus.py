"""Discovery and reading of text corpora.

Files are listed on the driver, where names with a leading dot or underscore
count too, and read by Spark tasks.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.errors import ConfigurationError
from corvane.functions.text import unix_lines

SUFFIXES = (".md", ".txt")


def require_folder(folder: str | Path) -> Path:
    path = Path(folder)
    if not path.exists():
        raise ConfigurationError(f"the documents folder {path} does not exist; create it or set docs_dir")
    if not path.is_dir():
        raise ConfigurationError(f"{path} is not a folder")
    return path


def excluded(path: Column, patterns: Sequence[str], folder: str = "") -> Column:
    """Whether a shell pattern matches the path relative to the folder, or the full path; ``*`` matches slashes."""
    found = F.lit(False)
    for pattern in patterns:
        expression = "^" + fnmatch.translate(pattern).replace("\\Z", "\\z")
        found = found | path.rlike(expression) | F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), path).rlike(expression)
    return found


def keep_documents(paths: DataFrame, exclude: Sequence[str] = (), folder: str = "", path_col: str = "source_path") -> DataFrame:
    """Rows whose path has a known suffix, in any case, and matches no exclude pattern."""
    suffix = F.lower(F.regexp_extract(path_col, r"[^/](\.[^./]+)$", 1))
    return paths.where(suffix.isin(*SUFFIXES) & ~excluded(F.col(path_col), exclude, folder))


def list_documents(folder: str | Path, exclude: Sequence[str] = ()) -> list[Path]:
    """Regular files with a known suffix, sorted by path components."""
    root = require_folder(folder)
    hidden = lambda p: any(fnmatch.fnmatchcase(x, e) for e in exclude for x in (p.relative_to(root).as_posix(), p.as_posix()))
    return sorted(p for p in root.rglob("*") if p.is_file() and p.suffix.lower() in SUFFIXES and not hidden(p))


def read_documents(spark: SparkSession, folder: str | Path, exclude: Sequence[str] = ()) -> DataFrame:
    """``(source_path, text)`` of a folder: strict UTF-8, line ends as line feeds; a bad file fails the read."""
    files = list_documents(folder, exclude)
    if not files:
        return spark.createDataFrame([], "source_path string, text string")
    # Spark skips names with a leading dot or underscore even when they are given, so these few are read here.
    unseen = [p for p in files if p.name[0] in "._"]
    seen = [p for p in files if p.name[0] not in "._"]
    kind = "path string, source_path string, content binary"
    raw = spark.createDataFrame([(p.as_posix(), p.as_posix(), p.read_bytes()) for p in unseen], kind)
    if seen:
        named = spark.createDataFrame([(p.absolute().as_uri().replace("file:///", "file:/"), p.as_posix()) for p in seen], "path string, source_path string")
        read = spark.read.format("binaryFile").load([p.absolute().as_uri() for p in seen]).select("path", "content")
        raw = raw.unionByName(read.join(named, "path"))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), unix_lines(F.col("content").cast("string"))).otherwise(F.raise_error(F.concat(F.lit("not valid UTF-8: "), F.col("source_path"))))
    return raw.select("source_path", text.alias("text"))
