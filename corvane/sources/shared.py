"""Intermediate tables in the folder that driver and executors share.

Every table has an owner that removes it: the innermost :func:`scratch` scope
that its thread has open for its session, or else the session, whose tables go
by :func:`release` or when the driver's process ends.  No scope knows of the
tables of another thread or session.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings of queries that are written: Spark deletes their shuffle files when they have ended, and sends at most so
#: many bytes at once to a Python worker (by itself 64 MB, held by the executor and by each worker, as text and as Arrow).
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Tasks for each core, at least, that files are dealt to in such queries: where there are a few more tasks than cores, most cores wait for the last ones.
READERS = 2
#: Rows of a file of a staged table, as one file is read by one task.
FILE_ROWS = 1 << 16
_open = threading.local()
_lock = threading.Lock()
#: Tables that belong to a session itself, and how many blocks write in it, with the settings before.
_of_session: dict[int, list[str]] = {}
_cleaning: dict[int, list] = {}


def _key(spark: SparkSession) -> int:
    return spark._jsparkSession.hashCode()


def _scopes(spark: SparkSession) -> list[list[str]]:
    """The scopes that this thread has open for a session."""
    return _open.__dict__.setdefault("scopes", {}).setdefault(_key(spark), [])


def owned(spark: SparkSession, path: str, lasting: bool = False) -> str:
    """``path``, removed with the scope it is made in; a lasting one goes with the scope around."""
    scopes = _scopes(spark)
    outer = scopes[: -1 if lasting else None]
    with _lock:
        (outer[-1] if outer else _of_session.setdefault(_key(spark), [])).append(path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a new local folder where it is unset and Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corvane-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/corvane/{label}-{uuid.uuid4().hex}"


@contextmanager
def writing(spark: SparkSession):
    """Queries that run inside leave no shuffle files and feed Python in small batches; for results that are written and not asked for again."""
    key = _key(spark)
    with _lock:
        settings = _WRITING | {"spark.sql.files.minPartitionNum": str(READERS * spark.sparkContext.defaultParallelism)}
        held = _cleaning.setdefault(key, [0, {name: spark.conf.get(name, None) for name in settings}])
        held[0] += 1
        for name, value in settings.items():
            spark.conf.set(name, value)
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _cleaning[key]
                for name, value in held[1].items():
                    if value is None:
                        spark.conf.unset(name)
                    else:
                        spark.conf.set(name, value)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders through Spark's file system."""
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, label: str, codec: str = "zstd", lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet and read it back: later jobs start from these files.

    This cuts the lineage, so a lost executor costs a re-read and not a
    recomputation, and it fixes values such as partition numbers for good.
    The files last until the :func:`scratch` scope ends; ``lasting`` ones, which
    the scope's result reads, until the scope around it does.
    """
    spark = df.sparkSession
    path = owned(spark, new_path(spark, label), lasting)
    with writing(spark):
        df.write.option("compression", codec).option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that this thread stages inside are removed at the end, also when it fails, but for lasting ones."""
    scopes = _scopes(spark)
    scopes.append([])
    try:
        yield
    finally:
        remove(spark, scopes.pop())


def discard(spark: SparkSession, table: DataFrame) -> None:
    """Remove one staged table ahead of its owner; frames that read it cannot be read after it."""
    files = table.inputFiles()
    for owner in (*_scopes(spark), _of_session.get(_key(spark), [])):
        gone = [path for path in owner if any(f"/{path.rpartition('/')[2]}/" in f for f in files)]
        remove(spark, gone)
        with _lock:
            owner[:] = [path for path in owner if path not in gone]


def release(spark: SparkSession) -> None:
    """Remove all tables that belong to the session itself; lazy results that read them cannot be read after it."""
    with _lock:
        gone = _of_session.pop(_key(spark), [])
    remove(spark, gone)


@atexit.register
def _at_exit() -> None:
    """What sessions still own goes with the driver's process, if its JVM is there."""
    spark = SparkSession._instantiatedSession
    if spark is None or spark.sparkContext._jsc is None:
        return
    for paths in list(_of_session.values()):
        try:
            remove(spark, paths)
        except Exception:  # The JVM may be gone; nothing is left to be done then.
            return
