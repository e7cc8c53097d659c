"""Token counts per document without materialising token ids.

Pieces are counted once per distinct pre-token: tasks cut texts into
pre-tokens and number the distinct ones of their block of documents; the
pre-tokens of all blocks meet in one shuffle, sorted, where the tokenizer sees
each one once; the counts are joined back to the pre-token frequencies of the
documents and summed.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.block_dictionary import pack, packed_by_block, unpack, values_of_block
from corvane.llm.staging import staged

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
BLOCK_PIECES = 6_000_000
ROW_DOCS = 500
_PLAIN_END = 0x250

_BLOCK_SCHEMA = "block long, start int, pieces array<string>, doc_ids array<long>, n_bytes array<long>, extra array<int>, sizes array<int>, places binary, times binary"


def _ranges(test: Callable[[str], bool]) -> str:
    """Character class body of all code points below ``_PLAIN_END`` that pass ``test``."""
    found = [c for c in range(_PLAIN_END) if test(chr(c))]
    out = ""
    for k, c in enumerate(found):
        if k == 0 or found[k - 1] != c - 1:
            out += f"\\u{c:04x}-"
        if k + 1 == len(found) or found[k + 1] != c + 1:
            out += f"\\u{c:04x}"
    return out


def pre_tokeniser(vocabulary: str) -> Callable[[str], tuple[list[str], int]]:
    """``text -> (pre-tokens, special tokens)`` as the byte-level tokenizer file defines them.

    Texts of Latin characters are cut by a regular expression with the
    letters and numbers of the Unicode tables spelt out; a text with any other
    character goes to the library's own pre-tokenizer.
    """
    from tokenizers import Tokenizer

    with open(vocabulary, encoding="utf-8") as lines:
        layout = json.load(lines)
    kind = layout["pre_tokenizer"]
    if layout["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
        raise ValueError("only byte-level tokenizers without normaliser are supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in layout["added_tokens"]):
        raise ValueError("added tokens that take white space are not supported")
    special = re.compile("|".join(re.escape(t["content"]) for t in layout["added_tokens"]) or r"(?!)")
    letter = _ranges(lambda c: unicodedata.category(c)[0] == "L")
    number = _ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = r"\t-\r \u0085 "
    plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
    other = re.compile(f"[^\\x00-\\u{_PLAIN_END - 1:04x}]")
    library = Tokenizer.from_file(vocabulary).pre_tokenizer

    def cut(text: str) -> tuple[list[str], int]:
        parts = special.split(text)
        found: list[str] = []
        for part in parts:
            if other.search(part):
                found.extend(part[i:j] for _, (i, j) in library.pre_tokenize_str(part))
            else:
                found.extend(plain.findall(part))
        return found, len(parts) - 1

    return cut


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    import public_tokenizers

    return vocabulary if "/" in vocabulary else str(public_tokenizers.path(vocabulary))


def pre_token_blocks(docs: DataFrame, vocabulary: str, block_pieces: int = BLOCK_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents with their numbered distinct pre-tokens; a row holds some documents of a block.

    ``pieces`` are the pre-tokens that the block first meets in this row,
    numbered from ``start``; ``places`` and ``times`` hold each document's
    distinct pre-tokens and their frequencies, ``sizes`` of them per document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut = pre_tokeniser(vocabulary_path(vocabulary))
        block = TaskContext.get().partitionId() << 32
        numbers: dict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        seen = start = 0
        docs_, places, times = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal start
            new = list(numbers)[start:] if start else list(numbers)
            ids, sizes_b, extra, sizes = zip(*docs_)
            ints = pa.list_(pa.int32())
            row = [
                pa.array([block], pa.int64()),
                pa.array([start], pa.int32()),
                pa.array([new], pa.list_(pa.string())),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([sizes_b], pa.list_(pa.int64())),
                pa.array([extra], ints),
                pa.array([sizes], ints),
                pa.array([pack(np.concatenate(places))], pa.binary()),
                pa.array([pack(np.concatenate(times))], pa.binary()),
            ]
            start = len(numbers)
            docs_.clear(), places.clear(), times.clear()
            return pa.RecordBatch.from_arrays(row, ["block", "start", "pieces", "doc_ids", "n_bytes", "extra", "sizes", "places", "times"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found, special = cut(text)
                counted = Counter(found)
                n = len(counted)
                place = np.fromiter(map(numbers.__getitem__, counted), np.int64, n)
                order = np.argsort(place)
                places.append(np.diff(place[order], prepend=0))
                times.append(np.fromiter(counted.values(), np.int64, n)[order])
                docs_.append((doc_id, len(text.encode()), special, n))
                seen += len(found)
                if len(docs_) >= ROW_DOCS or seen >= block_pieces:
                    yield close()
                if seen >= block_pieces:
                    block += 1
                    numbers.clear()
                    seen = start = 0
        if docs_:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _BLOCK_SCHEMA)


def piece_counts(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """``(block, place, piece)`` -> ``(block, place, value)``: tokens of each piece, counted once per distinct piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary_path(vocabulary))
        last, n_last = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            piece = batch.column(2)
            runs = piece.dictionary_encode()
            distinct = runs.dictionary.to_pylist()
            fresh = distinct[1:] if distinct[0] == last else distinct
            counted = [len(e.ids) for e in library.encode_batch(fresh, add_special_tokens=False)]
            n = np.array([n_last, *counted] if distinct[0] == last else counted, np.int64)
            last, n_last = distinct[-1], int(n[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n[runs.indices.to_numpy()])], ["block", "place", "value"])

    return pieces.repartition("piece").sortWithinPartitions("piece").select("block", "place", "piece").mapInArrow(run, "block long, place int, value long")


def _sum_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Token counts of the documents of one block."""
    total = sum(left.column("n_pieces").to_pylist())
    value = values_of_block(right, total)
    columns: list[list] = [[], [], []]
    for row in left.to_pylist():
        sizes = np.array(row["sizes"], np.int64)
        ends = np.cumsum(sizes)
        place = np.cumsum(unpack(row["places"]))
        # The differences start anew with each document.
        before = np.r_[0, place][np.r_[0, ends[:-1]]] if len(ends) else ends
        weight = value[place - np.repeat(before, sizes)] * unpack(row["times"]) if len(place) else place
        sums = np.diff(np.r_[0, np.cumsum(weight)][np.r_[0, ends]])
        columns[0] += row["doc_ids"]
        columns[1] += row["n_bytes"]
        columns[2].append(sums + np.array(row["extra"], np.int64))
    tokens = np.concatenate(columns[2]) if columns[2] else np.zeros(0, np.int64)
    return pa.table({"doc_id": pa.array(columns[0], pa.int64()), "n_bytes": pa.array(columns[1], pa.int64()), "n_tokens": pa.array(tokens)})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, block_pieces: int = BLOCK_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8) and n_tokens.

    Counts equal the tokenizer library's without begin, end or added tokens;
    the strings of special tokens inside texts count one, as the library does.
    Null and empty texts have no tokens; texts of any length are counted whole;
    rows that repeat, share an id or have none count on their own; other
    columns are not read, so names may clash; an empty table gives an empty
    result.
    """
    blocks = staged(pre_token_blocks(docs, vocabulary, block_pieces, id_col, text_col), "pre-tokens")
    pieces = blocks.select("block", "start", F.posexplode("pieces").alias("k", "piece")).select("block", (F.col("start") + F.col("k")).alias("place"), "piece")
    found = packed_by_block(piece_counts(pieces, vocabulary))
    left = blocks.withColumn("n_pieces", F.size("pieces")).drop("pieces", "start")
    return left.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_sum_block, "doc_id long, n_bytes long, n_tokens long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
