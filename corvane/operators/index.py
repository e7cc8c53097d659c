"""Incremental index: plan of changes, manifest, ingestion into a store.

The manifest first records which sources are about to change, then the store
is written, then the manifest is cleaned; whoever finds it dirty repairs.  Frames: ``current (source_path, checksum)`` and ``manifest
(source_path, checksum, chunk_ids)``.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import Settings, digest, index_fingerprint, storage_identity
from corvane.errors import DataFormatError, StoreError
from corvane.operators.records import file_lines, judged, line_numbers
from corvane.operators.store import CHUNK_SCHEMA, FIELDS, ParquetStore, check_records, check_vectors

__all__ = ["CHUNK_SCHEMA", "Manifest", "ParquetStore", "apply_changes", "atomic_write", "check_records", "check_vectors", "ingest", "load_jsonl", "locked", "needs_ingest", "plan", "update_manifest"]

LOCK_SECONDS = 10
#: Versions of manifests that are read, the first and the present one at the ends.
VERSIONS = (1, 2, 3)


def plan(manifest: DataFrame, current: DataFrame, dirty: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """``(source_path, action, write)``: removed, changed or kept, and whether to index it.

    Removed: known or dirty, but gone.  Changed: new, with another checksum,
    or dirty.
    """
    dirty = dirty if dirty is not None else current.select("source_path").limit(0)
    known = manifest.select("source_path", F.col("checksum").alias("old"), F.lit(True).alias("known"))
    marked = dirty.select("source_path").distinct().withColumn("dirty", F.lit(True))
    now = current.select("source_path", F.col("checksum").alias("new"), F.lit(True).alias("here"))
    rows = now.join(known, "source_path", "full").join(marked, "source_path", "full")
    changed = F.col("known").isNull() | ~F.col("old").eqNullSafe(F.col("new")) | F.coalesce("dirty", F.lit(False))
    action = F.when(F.col("here").isNull(), "removed").when(changed, "changed").otherwise("kept")
    return rows.select("source_path", action.alias("action")).withColumn("write", (F.col("action") == "changed") | (F.lit(everything) & (F.col("action") != "removed")))


def apply_changes(index: DataFrame, planned: DataFrame, chunks: DataFrame) -> DataFrame:
    """The next index: without removed and rewritten sources, with the new chunks."""
    gone = planned.where("action = 'removed' OR write").select("source_path")
    return index.join(gone, "source_path", "left_anti").select(*chunks.columns).unionByName(chunks)


def update_manifest(manifest: DataFrame, current: DataFrame, planned: DataFrame, chunks: DataFrame) -> DataFrame:
    """The next manifest: new chunk ids where a source was written, the old ones elsewhere."""
    made = chunks.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("made"))
    made = made.select("source_path", F.transform("made", lambda c: c["chunk_id"]).alias("made"))
    rows = current.join(planned.where("action <> 'removed'").select("source_path", "write"), "source_path").join(made, "source_path", "left")
    rows = rows.join(manifest.select("source_path", F.col("chunk_ids").alias("old")), "source_path", "left")
    none = F.array().cast("array<string>")
    return rows.select("source_path", "checksum", F.coalesce(F.when(F.col("write"), F.coalesce("made", none)).otherwise(F.col("old")), none).alias("chunk_ids"))


def atomic_write(path: Path, text: str) -> None:
    """Write next to the file, flush to disk, and swap."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


@contextmanager
def locked(path: Path, seconds: float = LOCK_SECONDS) -> Iterator[None]:
    """One writer at a time: an advisory lock on a file beside ``path``."""
    import fcntl

    path.parent.mkdir(parents=True, exist_ok=True)
    with open(f"{path}.lock", "w") as f:
        deadline = time.monotonic() + seconds
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() >= deadline:
                    raise StoreError("the index is in use by another writer", "locked") from None
                time.sleep(0.05)
        yield


@dataclass
class Manifest:
    """What an index was built from.

    The file is small: it names the Parquet tables, beside it, of all sources
    and of those about to change.  Files of earlier versions hold their sources
    themselves; without a storage identity they lead to a rebuild.
    """

    version: int = 3
    storage_identity: str | None = None
    index_fingerprint: str | None = None
    repair_required: bool = False
    table: str | None = None
    dirty: str | None = None
    path: Path | None = None
    inline: tuple[tuple[str, str, list[str]], ...] = ()
    inline_dirty: tuple[str, ...] = ()

    @classmethod
    def load(cls, path: Path) -> Manifest | None:
        if not path.exists():
            return None
        try:
            return cls._typed(json.loads(path.read_text(encoding="utf-8")), path)
        except (ValueError, KeyError, TypeError, AttributeError) as error:
            raise DataFormatError(f"{path} is no manifest: {error}") from None

    @classmethod
    def _typed(cls, raw: dict, path: Path) -> Manifest:
        """A manifest from its file's content; a value of another type is an error."""

        def checked(name: str, value, kind: type, optional: bool = False):
            if value is None and optional:
                return None
            if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
                raise TypeError(f"{name} is {type(value).__name__}")
            return value

        def strings(name: str, value) -> tuple[str, ...]:
            return tuple(checked(name, x, str) for x in checked(name, value, list))

        version = checked("version", raw.get("version", VERSIONS[0]), int)
        if version not in VERSIONS:
            raise ValueError(f"version {version} is unknown")
        if raw.get("storage_identity") == "":
            raise ValueError("storage_identity is empty")
        texts = [checked(name, raw.get(name), str, True) for name in ("storage_identity", "index_fingerprint")]
        tables = [checked(name, raw.get(name), str, True) for name in ("table", "dirty")]
        sources = checked("sources", raw.get("sources", {} if version == VERSIONS[-1] else None), dict)
        inline = tuple((k, checked("checksum", v["checksum"], str), list(strings("chunk_ids", v["chunk_ids"]))) for k, v in sources.items())
        return cls(version, *texts, checked("repair_required", raw.get("repair_required", False), bool), *tables, path, inline, strings("needs_reindex", raw.get("needs_reindex", [])))

    def must_rebuild(self, settings: Settings, identity: str) -> bool:
        """Whether the index has to be made anew because this manifest cannot tell whose it is.

        A manifest of the first version, or one that knows sources but no
        storage, leads a local index to a rebuild; a remote one is refused, as
        it may hold what others have put there.  So is a manifest of another index.
        """
        knows = bool(self.inline or self.inline_dirty or self.table or self.dirty or self.index_fingerprint or self.repair_required)
        unproven = self.path is not None and (self.version == VERSIONS[0] or (self.storage_identity is None and knows))
        if unproven and settings.backend != "local":
            raise StoreError("the manifest does not prove that the remote index is its own: check it, clear it, and move the manifest aside", "operation_failed")
        if not unproven and self.storage_identity not in (None, identity):
            raise StoreError("the manifest belongs to another index", "operation_failed")
        return unproven

    @property
    def is_dirty(self) -> bool:
        return self.repair_required or self.dirty is not None or bool(self.inline_dirty)

    def save(self, path: Path) -> None:
        body = {k: getattr(self, k) for k in ("version", "storage_identity", "index_fingerprint", "repair_required", "table", "dirty")}
        atomic_write(path, json.dumps(body, indent=2, sort_keys=True))

    def frame(self, spark: SparkSession) -> DataFrame:
        """``(source_path, checksum, chunk_ids)`` of all sources."""
        schema = "source_path string, checksum string, chunk_ids array<string>"
        if self.table is None:
            return spark.createDataFrame(list(self.inline), schema)
        return spark.read.schema(schema).parquet(tables_of(self.path, self.table))

    def dirty_frame(self, spark: SparkSession) -> DataFrame:
        """``(source_path)`` of the sources whose change was not finished."""
        if self.dirty is None:
            return spark.createDataFrame([(p,) for p in self.inline_dirty], "source_path string")
        return spark.read.schema("source_path string").parquet(tables_of(self.path, self.dirty))


def tables_of(path: Path, name: str) -> str:
    """Folder of a manifest's table."""
    return str(path.with_name(f"{path.name}.tables") / name)


def written_table(rows: DataFrame, path: Path, label: str) -> str:
    """Write a new table of the manifest; returns its name."""
    name = f"{label}-{uuid.uuid4().hex}"
    rows.write.parquet(tables_of(path, name))
    return name


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines, a file or a folder of them; a missing one is an empty index, the first bad line is named by file and number."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], CHUNK_SCHEMA)
    lines = file_lines(spark, path)
    found = judged(lines)
    bad = found.where(F.size("reasons") > 0)
    if bad.limit(1).count():
        first = line_numbers(lines, bad).orderBy("file", "line").first()
        raise DataFormatError(f"{path}, {first.file.rpartition('/')[2]}, line {first.line}: {', '.join(first.reasons)}")
    return found.select("record.*").select(*FIELDS)


def ingest(spark: SparkSession, settings: Settings, documents: DataFrame, store: ParquetStore, provider=None) -> dict:
    """Bring the index up to date with ``documents (source_path, text)``; returns counts and the embedding status."""
    from corvane.functions.text import checksum
    from corvane.operators.chunking import chunk_documents
    from corvane.operators.embedding import embed
    from corvane.sources.shared import remove, scratch, staged

    path = Path(settings.manifest_path)
    with locked(path), scratch(spark):
        current = documents.select("source_path", checksum(F.col("text")).alias("checksum"))
        old = Manifest.load(path) or Manifest()
        identity = storage_identity(settings)
        unproven = old.must_rebuild(settings, identity)
        fingerprint = index_fingerprint(settings, wanted_mode(provider))
        rebuild = not store.supports_incremental_updates or unproven or old.storage_identity is None or old.repair_required or not store.exists() or old.index_fingerprint != fingerprint
        known = old.frame(spark)
        planned = staged(plan(known, current, old.dirty_frame(spark), rebuild), "ingest-plan")
        write = planned.where("write").select("source_path")
        made, status = embed(chunk_documents(documents.join(write, "source_path"), settings.chunk_strategy, settings.chunk_size, settings.chunk_overlap), provider, settings.embedding_batch, settings.embedding_retries, settings.embedding_backoff_ms, journal=vector_journal(settings, provider))
        if store.requires_live_embeddings and status["mode"] == "fallback":
            raise StoreError("this store takes only live vectors", "operation_failed")
        made = staged(made.select(*FIELDS), "ingest-chunks")
        intent = planned.where("write OR action = 'removed'").select("source_path").union(old.dirty_frame(spark)).distinct()
        gone = [old.table, old.dirty]
        if intent.limit(1).count():
            # Sources stay where they are until the store is written; whoever finds this repairs.
            dirty = written_table(intent, path, "dirty")
            gone.append(dirty)
            table = old.table or written_table(known, path, "sources")
            gone.append(table)
            Manifest(3, identity, fingerprint, True, table, dirty).save(path)
            if rebuild:
                store.save(made)
            else:
                store.apply(made, planned.where("write OR action = 'removed'").select("source_path"))
        elif not store.exists():
            store.save(made)
        table = written_table(update_manifest(known, current, planned, made), path, "sources")
        actual = index_fingerprint(settings, wanted_mode(provider if status["mode"] == "live" else None))
        new = Manifest(3, identity, actual, False, table, path=path)
        new.save(path)
        counts = {r.action: r["count"] for r in planned.groupBy("action").count().collect()}
        n, chunks = new.frame(spark).agg(F.count("*"), F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0))).first()
        remove(spark, [tables_of(path, name) for name in dict.fromkeys(gone) if name])
        return {"documents": n, "chunks": chunks, "removed": counts.get("removed", 0), "changed": counts.get("changed", 0), "embedding": status}


def vector_journal(settings: Settings, provider) -> str:
    """Folder of the vectors that a kind of provider has made for this index with the settings' model."""
    kind = f"{type(provider).__module__}:{type(provider).__qualname__}"
    return f"{settings.index_path.rstrip('/')}-vectors/{digest({'model': settings.embedding_model, 'kind': kind})[:16]}"


def wanted_mode(provider) -> str:
    """The kind of vectors that an index should have: a key alone makes none, a provider does."""
    return "fallback" if provider is None else "live"


def needs_ingest(settings: Settings, store: ParquetStore, provider=None) -> bool:
    """Whether a reader must ingest first: settings changed, repair due, dirty sources or no store.  Edited files alone do not count."""
    old = Manifest.load(Path(settings.manifest_path))
    mode = wanted_mode(provider)
    return old is None or old.is_dirty or not store.exists() or old.index_fingerprint != index_fingerprint(settings, mode) or old.storage_identity != storage_identity(settings)
