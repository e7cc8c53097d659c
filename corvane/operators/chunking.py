"""Chunking of documents with exact character spans.

A document is chunked where it is read, so nothing is shuffled: one Arrow
function walks its lines once, folds them to sections or paragraph blocks,
joins the blocks to chunks and returns a row a chunk.  The time is linear in a
document's length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.config import CHUNK_STRATEGIES, check_chunk_sizes, chosen
from corvane.functions import text as T
from corvane.functions.batches import pieces

_CHUNKS = (
    "chunk_id string, source_path string, title string, text string, chunk_index int, start_char int, end_char int, "
    "metadata struct<start:int,end:int,chunk_strategy:string,source_title:string,section_title:string,heading_level:int>"
)
_HEADING = re.compile(T.HEADING)
#: Bytes of texts that are chunked together; a longer text is chunked alone.
PIECE_BYTES = 1 << 20


class Span(NamedTuple):
    """A text with its place in the document, and the section that it stands in."""

    text: str
    first: int
    past: int
    title: str
    level: int | None


def heading_of(line: str) -> tuple[str, int] | None:
    """Title and level of a heading line."""
    flat = line.strip()
    found = _HEADING.match(flat) if flat.startswith("#") else None
    title = found[2].strip() if found else ""
    return (title, len(found[1])) if title else None


def windows(text: str, first: int, past: int, size: int, step: int) -> Iterator[tuple[str, int, int]]:
    """Overlapping windows of a span, stripped, without the blank ones."""
    begin = first
    while True:
        raw = text[begin : min(begin + size, past)]
        body = raw.strip()
        if body:
            left = begin + len(raw) - len(raw.lstrip())
            yield body, left, left + len(body)
        if begin + size >= past:
            return
        begin += step


def sections(text: str, lines: list[str], source_title: str) -> list[Span]:
    """Ranges between headings that hold any text, as spans without their text; the whole document if there are none."""
    found, at, first, title, level = [], 0, 0, source_title, None
    for line in [*lines, None]:
        head = ("", 0) if line is None else heading_of(line)
        if head:
            if text[first:at].strip():
                found.append(Span("", first, at, title, level))
            first, (title, level) = at + len(line or ""), head
        at += len(line or "")
    return found or [Span("", 0, len(text), source_title, None)]


def section_at(found: list[Span], starts: list[int], offset: int) -> Span:
    """The section that holds the offset, else the last section."""
    k = bisect_right(starts, offset) - 1
    return found[k] if k >= 0 and offset < found[k].past else found[-1]


def blocks(text: str, lines: list[str], source_title: str, headings: bool, size: int, step: int) -> list[Span]:
    """Runs of lines that are neither blank nor headings; larger ones than ``size`` are cut to windows."""
    out, at, title, level = [], 0, source_title, None
    run: list[str] = []
    first = 0

    def put() -> None:
        body = "\n".join(x.rstrip() for x in run).strip()
        past = at - len(run[-1]) + len(run[-1].rstrip("\r\n"))
        if len(body) <= size:
            out.append(Span(body, first, past, title, level))
        else:
            out.extend(Span(*w, title, level) for w in windows(text, first, past, size, step))
        run.clear()

    for line in lines:
        head = heading_of(line) if headings else None
        if head or not line.strip():
            if run:
                put()
            title, level = head or (title, level)
        else:
            first = first if run else at
            run.append(line)
        at += len(line)
    if run:
        put()
    return out


def groups(spans: list[Span], size: int, overlap: int, by_section: bool) -> Iterator[tuple[int, int]]:
    """(first, past) of the blocks of each chunk.

    A group takes blocks while their joined text fits and, with ``by_section``,
    the title stays; the next one begins at the last block from which on the
    texts reach ``overlap`` characters, and at least one block later.
    """
    n = len(spans)
    total = [0, *accumulate(len(s.text) for s in spans)]
    joined = [total[j + 1] + 2 * j for j in range(n)]  # rises, so what fits is found by bisection
    change = [n] * n
    for j in range(n - 2, -1, -1):
        change[j] = j + 1 if by_section and spans[j + 1].title != spans[j].title else change[j + 1]
    begin = 0
    while begin < n:
        fits = bisect_right(joined, size + total[begin] + 2 * begin)
        past = max(begin + 1, min(fits, change[begin]))
        yield begin, past
        if past == n:
            return
        begin = max(begin + 1, min(past - 1, bisect_right(total, total[past] - overlap) - 1))


def chunks_of(text: str, source_title: str, strategy: str, size: int, overlap: int) -> Iterator[tuple[str, int, int, str, str, int | None, str]]:
    """(text, first, past, title, section title, heading level, strategy) of each chunk of one document."""
    if not text.strip():
        return
    lines = text.splitlines(keepends=True)
    step = size - overlap
    own = [] if strategy == "fixed" else blocks(text, lines, source_title, strategy == "markdown", size, step)
    if not own:
        found = sections(text, lines, source_title)
        starts = [s.first for s in found]
        for body, first, past in windows(text, 0, len(text), size, step):
            s = section_at(found, starts, first)
            yield body, first, past, s.title, s.title, s.level, "fixed"
    for a, b in groups(own, size, overlap, strategy == "markdown"):
        last = own[b - 1]
        yield "\n\n".join(s.text for s in own[a:b]), own[a].first, last.past, last.title or source_title, last.title, last.level, strategy


def chunked(strategy: str, size: int, overlap: int):
    """An Arrow function ``(source_path, source_title, text)`` -> chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.int32()
        # A piece at a time: its texts, their chunks and what they become are in memory together.
        for batch in (piece for whole in batches for piece in pieces(whole, 2, size=PIECE_BYTES)):
            ids, paths, source_titles, nth, rows = [], [], [], [], []
            for path, title, text in zip(*(c.to_pylist() for c in batch.columns)):
                for k, chunk in enumerate(chunks_of(text, title, strategy, size, overlap)):
                    ids.append(f"{path}::chunk-{k}")
                    paths.append(path)
                    source_titles.append(title)
                    nth.append(k)
                    rows.append(chunk)
            body, first, past, title, section, level, made_by = zip(*rows) if rows else ((),) * 7
            first, past = pa.array(first, ints), pa.array(past, ints)
            meta = [first, past, pa.array(made_by, pa.string()), pa.array(source_titles, pa.string()), pa.array(section, pa.string()), pa.array(level, ints)]
            metadata = pa.StructArray.from_arrays(meta, ["start", "end", "chunk_strategy", "source_title", "section_title", "heading_level"])
            texts = [pa.array(x, pa.string()) for x in (ids, paths, title, body)]
            yield pa.RecordBatch.from_arrays([*texts, pa.array(nth, ints), first, past, metadata], ["chunk_id", "source_path", "title", "text", "chunk_index", "start_char", "end_char", "metadata"])

    return run


def chunk_documents(docs: DataFrame, strategy: str = "markdown", size: int = 800, overlap: int = 120) -> DataFrame:
    """``(source_path, text)`` -> chunks with ids, spans, titles and metadata.

    Blank documents have no chunks.  A document without paragraph blocks is
    cut into fixed windows and labelled so.
    """
    check_chunk_sizes(size, overlap)
    strategy = chosen(strategy, CHUNK_STRATEGIES, "markdown", "chunk strategy")

    rows = docs.select("source_path", T.title_of(F.col("source_path")).alias("source_title"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(chunked(strategy, size, overlap), _CHUNKS)
