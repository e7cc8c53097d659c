"""The index on disk: segments that are merged when read, and a log of versions.

A change writes one segment: the chunks that come, in order of path and number;
their postings; a delete vector that names, by segment and position, the rows
of earlier segments that go; and the differences in document frequencies,
number and length of chunks.  So what is written grows with the change and not
with the index, and statistics are sums over the segments.  Segments at the end
of the list are merged when there are many, the larger ones seldom.

A version is a small file of the log, moved into its place only if no other
writer has put one there.  Readers keep the version that they opened; files
that none of the last versions names are removed after a commit.  All paths go
through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.errors import StoreError
from corvane.operators import postings
from corvane.sources.shared import remove, scratch, staged

CHUNK_SCHEMA = (
    "chunk_id string, source_path string, title string, text string, chunk_index int, start_char int, end_char int, "
    "metadata struct<start:int,end:int,chunk_strategy:string,source_title:string,section_title:string,heading_level:int>, embedding array<double>"
)
FIELDS = ("chunk_id", "source_path", "title", "text", "chunk_index", "start_char", "end_char", "metadata", "embedding")
DEAD_SCHEMA = "segment string, position long"
BROADCAST_ROWS = 200_000
MOST_SEGMENTS = 8
KEPT_VERSIONS = 2
#: Positions of one segment lie below this; the place of a segment in its version goes above.
POSITIONS = 1 << 52


def check_vectors(chunks: DataFrame) -> int | None:
    """The one length of all vectors, or None for no chunks; anything else is an error."""
    size = F.size("embedding")
    low, high, missing, n = chunks.agg(F.min(size), F.max(size), F.sum(F.col("embedding").isNull().cast("int")), F.count("*")).first()
    if not n:
        return None
    if missing or low != high or low < 1:
        raise StoreError("all chunks need vectors of one length", "invalid_vectors")
    return low


def check_records(chunks: DataFrame) -> DataFrame:
    """``chunks``, failing where a record lacks a field or has an impossible span."""
    text = [F.col(c).isNotNull() for c in ("chunk_id", "source_path", "title", "text")]
    good = (F.col("chunk_index") >= 0) & (F.col("start_char") >= 0) & (F.col("end_char") >= F.col("start_char"))
    for t in text:
        good = good & t
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("bad chunk record: "), F.coalesce("chunk_id", F.lit("?")))))
    return chunks.withColumn("chunk_id", checked)


def side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, as the small side of a join: broadcast below a bound, sorted and merged beyond it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


@dataclass(frozen=True)
class Segment:
    """What one change wrote.  ``chunks`` and ``length`` are differences: what came less what went."""

    name: str
    rows: int
    dead: int
    chunks: int
    length: int
    vector_size: int | None


@dataclass(frozen=True)
class Version:
    number: int = 0
    segments: tuple[Segment, ...] = field(default=())

    @property
    def chunks(self) -> int:
        return sum(s.chunks for s in self.segments)

    @property
    def average(self) -> float:
        """Mean number of terms of a chunk."""
        return sum(s.length for s in self.segments) / self.chunks if self.chunks else 0.0

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)


class ParquetStore:
    """A folder of segments and the log of their versions."""

    def __init__(self, path: str | Path, incremental: bool = True, live_vectors_only: bool = False, most_segments: int = MOST_SEGMENTS, kept_versions: int = KEPT_VERSIONS):
        self.path = str(path).rstrip("/")
        self.supports_incremental_updates = incremental
        self.requires_live_embeddings = live_vectors_only
        self.most_segments = most_segments
        self.kept_versions = max(kept_versions, 1)

    # --- files ---

    def _hadoop(self, name: str = ""):
        spark = SparkSession.active()
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return spark, path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        _, path, files = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _log(self) -> list[str]:
        return [n for n in self._names("log") if n.endswith(".json") and n[0] != "."]

    def _put(self, number: int, body: str) -> None:
        """Write a file of the log whole, then move it to its name unless that is taken."""
        spark, target, files = self._hadoop(f"log/{number:012d}.json")
        _, draft, _ = self._hadoop(f"log/.{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(body.encode())
        out.close()
        jvm = spark._jvm.org.apache.hadoop.fs
        try:
            context = jvm.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(files.makeQualified(draft), files.makeQualified(target), spark.sparkContext._gateway.new_array(getattr(jvm, "Options$Rename"), 0))
        except Py4JJavaError as error:
            files.delete(draft, False)
            raise StoreError(f"another writer has made version {number}", "locked") from error

    def folder(self, segment: Segment, table: str) -> str:
        return f"{self.path}/segments/{segment.name}/{table}"

    # --- versions ---

    def exists(self) -> bool:
        return bool(self._log())

    @property
    def pointer(self) -> Path:
        """The file of the present version."""
        return Path(self.path) / "log" / self._log()[-1]

    def version(self, number: int | None = None) -> Version:
        """The present version, or an earlier one that is still kept."""
        names = self._log()
        if not names:
            return Version()
        spark, path, files = self._hadoop(f"log/{names[-1] if number is None else f'{number:012d}.json'}")
        stream = files.open(path)
        try:
            raw = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(raw["number"], tuple(Segment(**s) for s in raw["segments"]))

    # --- reading ---

    def _dead(self, spark: SparkSession, segments: tuple[Segment, ...]) -> tuple[DataFrame, int]:
        having = [s for s in segments if s.dead]
        if not having:
            return spark.createDataFrame([], DEAD_SCHEMA), 0
        return spark.read.schema(DEAD_SCHEMA).parquet(*[self.folder(s, "dead") for s in having]), sum(s.dead for s in having)

    def rows(self, spark: SparkSession, version: Version, segments: tuple[Segment, ...] | None = None) -> DataFrame:
        """The live rows of a version, or of some of its segments: segment, position, and the fields of a chunk."""
        chosen = version.segments if segments is None else segments
        if not chosen:
            return spark.createDataFrame([], f"segment string, position long, {CHUNK_SCHEMA}")
        parts = [spark.read.schema(f"position long, {CHUNK_SCHEMA}").parquet(self.folder(s, "chunks")).withColumn("segment", F.lit(s.name)) for s in chosen]
        dead, n = self._dead(spark, version.segments)
        found = reduce(DataFrame.unionByName, parts)
        return found.join(side(dead, n), ["segment", "position"], "left_anti") if n else found

    def load(self, spark: SparkSession, vectors: bool = True, version: int | None = None) -> DataFrame:
        """The chunks of a version; without ``vectors`` the column is not read."""
        found = self.rows(spark, self.version(version)).drop("segment", "position")
        return found if vectors else found.drop("embedding")

    def corpus(self, spark: SparkSession, version: Version | None = None) -> DataFrame:
        """The chunks as a corpus for ranking; positions rise with path and chunk number within each segment."""
        version = self.version() if version is None else version
        rows = self.rows(spark, version)
        first = F.create_map(*[F.lit(x) for k, s in enumerate(version.segments) for x in (s.name, k * POSITIONS)]) if version.segments else F.create_map(F.lit(""), F.lit(0))
        section, source = F.col("metadata.section_title"), F.col("metadata.source_title")
        return rows.select(
            (first[F.col("segment")] + F.col("position")).cast("long").alias("position"), *[c for c in rows.columns if c not in ("segment", "position", "embedding")],
            postings.searchable().alias("searchable"), F.concat_ws(" ", "title", section, source).alias("metadata_text"), F.col("embedding").alias("vector"),
        )

    def statistics(self, spark: SparkSession, version: Version | None = None) -> DataFrame:
        """``(term, df)`` of all live chunks, as sums of the segments' differences."""
        version = self.version() if version is None else version
        if not version.segments:
            return spark.createDataFrame([], "term string, df long")
        parts = spark.read.schema("term string, df long").parquet(*[self.folder(s, "terms") for s in version.segments])
        return parts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def lexical(self, queries: DataFrame, k: int, version: Version | None = None, **options) -> DataFrame:
        """BM25 over the stored postings: ``(query_id, rank, position, chunk_id, score)``; equal scores by path and chunk number."""
        spark = queries.sparkSession
        version = self.version() if version is None else version
        found = self.lexical_scores(queries, k, version, **options).where("position IS NOT NULL").drop("blocks", "read")
        return postings.best(found, self._order_keys(spark, version), k)

    def lexical_scores(self, queries: DataFrame, k: int, version: Version | None = None, **options) -> DataFrame:
        """What :func:`postings.search` finds in the segments of a version: the best of each zone, and the blocks it had and read."""
        spark = queries.sparkSession
        version = self.version() if version is None else version
        place = {s.name: n for n, s in enumerate(version.segments)}
        parts = [spark.read.schema(postings.SCHEMA).parquet(self.folder(s, "postings")).withColumn("segment", F.lit(n)) for n, s in enumerate(version.segments)]
        if not parts:
            kind = queries.schema["query_id"].dataType.simpleString()
            return spark.createDataFrame([], postings.found_schema(kind))
        dead, _ = self._dead(spark, version.segments)
        number = F.create_map(*[F.lit(x) for item in place.items() for x in item])[F.col("segment")]
        gone = dead.select(number.alias("segment"), "position").where("segment IS NOT NULL")
        stored = reduce(DataFrame.unionByName, parts)
        return postings.search(stored, gone, self.statistics(spark, version), queries, version.chunks, version.average, k, POSITIONS, **options)

    def _order_keys(self, spark: SparkSession, version: Version) -> DataFrame:
        """``(position, chunk_id, source_path, chunk_index)`` of all rows, dead ones too."""
        parts = [
            spark.read.schema("position long, chunk_id string, source_path string, chunk_index int").parquet(self.folder(s, "chunks")).withColumn("position", F.col("position") + n * POSITIONS)
            for n, s in enumerate(version.segments)
        ]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "position long, chunk_id string, source_path string, chunk_index int")

    def export_jsonl(self, spark: SparkSession, path: str) -> None:
        """The present version as a folder of JSON lines, ranges of sorted paths a file."""
        self.load(spark).orderBy("source_path", "chunk_index").write.mode("overwrite").json(path)

    # --- writing ---

    def save(self, chunks: DataFrame) -> Version:
        """Replace everything by ``chunks``."""
        return self._commit(Version(self.version().number), chunks, None)

    def apply(self, chunks: DataFrame, replaced: DataFrame) -> Version:
        """Add ``chunks``; all earlier chunks of the sources in ``replaced (source_path)`` go."""
        version = self._commit(self.version(), chunks, replaced)
        return self._merge_if_due(version)

    def _commit(self, base: Version, chunks: DataFrame, replaced: DataFrame | None) -> Version:
        spark = chunks.sparkSession
        size = check_vectors(chunks)
        known = {s.vector_size for s in base.segments if s.vector_size is not None}
        if size is not None and known and known != {size}:
            raise StoreError("all chunks need vectors of one length", "invalid_vectors")
        with scratch(spark):
            gone = spark.createDataFrame([], f"segment string, position long, {CHUNK_SCHEMA}")
            if replaced is not None and base.segments:
                sources = staged(replaced.select("source_path").distinct(), "replaced")
                gone = self.rows(spark, base).join(side(sources, sources.count()), "source_path", "left_semi")
                gone = staged(gone.select("segment", "position", "title", "metadata", "text"), "gone")
            segment = self._write(check_records(chunks), gone, size)
        return self._publish(base.number + 1, (*base.segments, segment))

    def _write(self, chunks: DataFrame, gone: DataFrame, size: int | None, carried: DataFrame | None = None, terms: DataFrame | None = None) -> Segment:
        """Write a segment; ``gone`` are the rows that it removes, ``carried`` further entries of its delete vector, ``terms`` its differences if they are known."""
        spark = chunks.sparkSession
        name = uuid.uuid4().hex
        draft = Segment(name, 0, 0, 0, 0, size)
        ordered = chunks.select(*FIELDS)
        ordered = ordered.repartitionByRange("source_path", "chunk_index").sortWithinPartitions("source_path", "chunk_index", "chunk_id")
        ordered.select(F.monotonically_increasing_id().alias("position"), *ordered.columns).write.parquet(self.folder(draft, "chunks"))
        written = spark.read.schema(f"position long, {CHUNK_SCHEMA}").parquet(self.folder(draft, "chunks"))
        postings.build(written).write.parquet(self.folder(draft, "postings"))
        made = spark.read.schema(postings.SCHEMA).parquet(self.folder(draft, "postings"))

        here, there = (postings.sizes(x) for x in (written, gone))
        (rows, length), (n_gone, length_gone) = here.first(), there.first()
        if terms is None:
            came = made.select("term", F.size("docs").cast("long").alias("df"))
            went = postings.distinct_terms(gone).select("term", F.lit(-1).cast("long").alias("df"))
            terms = came.unionByName(went).groupBy("term").agg(F.sum("df").alias("df"))
        terms.where("df <> 0").sortWithinPartitions("term").write.parquet(self.folder(draft, "terms"))
        dead = gone.select("segment", "position")
        dead = dead if carried is None else dead.unionByName(carried)
        n_dead = dead.count()
        if n_dead:
            dead.write.parquet(self.folder(draft, "dead"))
        return Segment(name, rows, n_dead, rows - n_gone, length - length_gone, size)

    def _publish(self, number: int, segments: tuple[Segment, ...]) -> Version:
        version = Version(number, segments)
        try:
            self._put(number, json.dumps({"number": number, "segments": [vars(s) for s in segments]}, indent=1))
        except StoreError:
            # Only the last segment is this writer's own.
            remove(SparkSession.active(), [f"{self.path}/segments/{segments[-1].name}"])
            raise
        self.vacuum()
        return version

    def _merge_if_due(self, version: Version) -> Version:
        """Merge the last segments into one: all of them when half of the rows are dead, else those that together outgrow the one before."""
        segments = version.segments
        if version.rows and version.chunks * 2 < version.rows:
            first = 0
        elif len(segments) > self.most_segments:
            first, size = len(segments) - 1, segments[-1].rows
            while first > 0 and (segments[first - 1].rows <= 2 * size or len(segments) - first < 2):
                first -= 1
                size += segments[first].rows
        else:
            return version
        return self.merge(version, first)

    def merge(self, version: Version | None = None, first: int = 0) -> Version:
        """One segment in place of all from the ``first`` on; the same chunks and statistics."""
        spark = SparkSession.active()
        version = self.version() if version is None else version
        before, merged = version.segments[:first], version.segments[first:]
        with scratch(spark):
            live = staged(self.rows(spark, version, merged).drop("segment", "position"), "merged")
            names = [s.name for s in before]
            carried = self._dead(spark, merged)[0].where(F.col("segment").isin(names))
            parts = spark.read.schema("term string, df long").parquet(*[self.folder(s, "terms") for s in merged])
            none = spark.createDataFrame([], f"segment string, position long, {CHUNK_SCHEMA}")
            sizes = [s.vector_size for s in merged if s.vector_size is not None]
            made = self._write(live, none, sizes[0] if sizes else None, carried, parts.groupBy("term").agg(F.sum("df").alias("df")))
        made = Segment(made.name, made.rows, made.dead, sum(s.chunks for s in merged), sum(s.length for s in merged), made.vector_size)
        return self._publish(version.number + 1, (*before, made))

    def vacuum(self) -> list[str]:
        """Remove versions before the last ones that are kept, and segments that no kept version names; returns what went."""
        names = self._log()
        old, kept = names[: -self.kept_versions], names[-self.kept_versions :]
        used = {s.name for n in kept for s in self.version(int(n.partition(".")[0])).segments}
        # A segment that the log does not name yet may be another writer's: only those of removed versions go.
        gone = {s.name for n in old for s in self.version(int(n.partition(".")[0])).segments} - used
        paths = [f"{self.path}/segments/{name}" for name in sorted(gone)] + [f"{self.path}/log/{n}" for n in old]
        remove(SparkSession.active(), paths)
        return paths
