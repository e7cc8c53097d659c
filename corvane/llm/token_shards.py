"""Training-order materialisation of token ids as binary shards.

Documents are dealt to blocks by a hash of their id and text and sorted inside
them, so what stands next to what depends on the data and a key alone, not on
how Spark deals files to tasks.  The documents of a block become one stream of
ids, each followed by an end token, and the stream is cut into sequences of
fixed length.  Once the sequences of all blocks are counted, each has a number
from 0 to N - 1; a keyed Feistel network with cycle-walking permutes exactly
these numbers, and the permuted number is the sequence's global slot.  Shards
are equal ranges of slots: one file of fixed-stride records each, so the shard
and the byte of a slot follow by division, and a reader can start at any slot.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.staging import new_path, owned, scratch, staged

VOCABULARY = "byte_bpe_50k.tiktoken"
LENGTH = 2048
KEY = 20240229
ROUNDS = 6
#: Bytes of text of a block; with more than MOST_BLOCKS blocks they grow instead, so a count a block always fits the driver.
BLOCK_BYTES = 8_000_000
MOST_BLOCKS = 65_536
#: Bytes of a shard: the least, unless there are over MANY_SHARDS, and the most.
SHARD_BYTES = (32_000_000, 128_000_000)
MANY_SHARDS = 4096
GROUP = 256
HOLD_BYTES = 24_000_000
HEADER = [("first_doc", "<i8"), ("first_token", "<i4"), ("n_tokens", "<i4")]

_SEQUENCES = "block int, place int, n int, records binary, doc_ids array<array<long>>, doc_tokens array<array<int>>"


def feistel(index: np.ndarray, domain: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of ``0 .. domain - 1`` chosen by ``key``, for an array of indexes.

    A balanced Feistel network permutes the next power of four; a value beyond
    the domain is sent through it again until it falls inside.
    """
    half = max(1, (max(2, domain) - 1).bit_length() + 1 >> 1)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def mixed(x: np.ndarray, r: int) -> np.ndarray:
        x = x + np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1))
        for s, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(s))) * np.uint64(m)
        return (x ^ (x >> np.uint64(31))) & mask

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(rounds):
            left, right = right, left ^ mixed(right, r)
        return (left << shift) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        out_of = out >= np.uint64(domain)
        while out_of.any():
            out[out_of] = once(out[out_of])
            out_of = out >= np.uint64(domain)
    return out


def vocabulary_path(vocabulary: str) -> str:
    """A path as it is; a bare file name is looked up among the installed public tokenizers."""
    import public_tokenizers

    return vocabulary if "/" in vocabulary else str(public_tokenizers.path(vocabulary))


def load_vocabulary(vocabulary: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(vocabulary_path(vocabulary), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def end_token(ranks: dict[bytes, int]) -> int:
    """The id after the vocabulary's last one ends a document."""
    return max(ranks.values(), default=-1) + 1


def id_type(end: int) -> str:
    """Two bytes an id where the vocabulary and its end token allow it, else four."""
    return "<u2" if end < 1 << 16 else "<u4"


def record_dtype(length: int, ids: str) -> np.dtype:
    """One record of a shard without its line end: header, and ids padded with the end token."""
    return np.dtype([*HEADER, ("ids", ids, (length,))])


def sequences(docs: DataFrame, blocks: int, vocabulary: str, length: int, key: int, id_col: str, text_col: str) -> DataFrame:
    """Groups of consecutive sequences: block, place of the first, number, compressed records, and the documents in each."""
    ranks = load_vocabulary(vocabulary)
    end = end_token(ranks)
    layout = record_dtype(length, id_type(end))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text", F.lit(key)), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")
    rows = rows.repartition("block").sortWithinPartitions("block", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken
        import zstandard

        ranks = load_vocabulary(vocabulary)
        encode = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        packer = zstandard.ZstdCompressor(level=3)
        block, place = None, 0
        held: list[tuple[int | None, int, np.ndarray]] = []  # (doc_id, first token, ids)
        size = 0

        def cut(n: int) -> pa.RecordBatch:
            """The next n sequences of the block; only the block's last one may be short."""
            nonlocal place, held, size
            starts = np.cumsum([0, *(len(x[2]) for x in held)])
            whole = min(size, n * length)
            out = np.zeros(n, layout)
            flat = np.full(n * length, end, layout["ids"].base)
            flat[:whole] = np.concatenate([x[2] for x in held])[:whole]
            out["ids"] = flat.reshape(n, length)
            firsts = np.arange(n) * length
            lasts = np.minimum(firsts + length, size)
            owner = np.searchsorted(starts, firsts, "right") - 1
            past = np.searchsorted(starts, lasts, "left")
            ids = [x[0] for x in held]
            out["first_doc"] = [-1 if ids[k] is None else ids[k] for k in owner]
            out["first_token"] = np.array([x[1] for x in held])[owner] + firsts - starts[owner]
            out["n_tokens"] = lasts - firsts
            names = [ids[a:b] for a, b in zip(owner, past)]
            tokens = [np.diff(np.clip(starts[a : b + 1], i, j)).tolist() for a, b, i, j in zip(owner, past, firsts, lasts)]
            k = int(np.searchsorted(starts, whole, "right")) - 1
            used = whole - int(starts[k])
            held = [(held[k][0], held[k][1] + used, held[k][2][used:]), *held[k + 1 :]] if whole < size else []
            size -= whole
            place += n
            row = (block, place - n, n, packer.compress(out.tobytes()), names, tokens)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["block", "place", "n", "records", "doc_ids", "doc_tokens"])

        for batch in batches:
            for b, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if b != block:
                    if size:
                        yield cut(-(-size // length))
                    block, place = b, 0
                ids = encode(text.as_py(), allowed_special=set(), disallowed_special=())
                held.append((doc_id, 0, np.append(ids, end).astype(layout["ids"].base)))
                size += len(ids) + 1
                while size >= GROUP * length:
                    yield cut(GROUP)
        if size:
            yield cut(-(-size // length))

    return rows.mapInArrow(run, _SEQUENCES)


def slots_of(offsets: np.ndarray, total: int, key: int) -> Callable[[int, int, int], np.ndarray]:
    """``(block, place, n) -> slots`` of n consecutive sequences, by the Feistel network over all ``total`` of them."""
    return lambda block, place, n: feistel(np.arange(offsets[block] + place, offsets[block] + place + n), total, key).astype(np.int64)


def written_records(cut: DataFrame, offsets: np.ndarray, total: int, per_shard: int, shards: int, key: int, layout: np.dtype) -> DataFrame:
    """``(value)``: the records of all shards in order, shard k in partition k.

    What a task has for a shard travels compressed as one row; a shard is put
    together in an array of its final size, each record at its slot.
    """
    slots = slots_of(offsets, total, key)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for shard, parts in held.items():
                place, records = (np.concatenate(x) for x in zip(*parts))
                row = (shard, place.astype("<i4").tobytes(), packer.compress(records.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.binary(), pa.binary()))], ["shard", "places", "records"])
            held.clear()

        for batch in batches:
            for block, place, n, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                records = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), layout)
                slot = slots(block, place, n)
                order = np.argsort(slot)
                shard = slot[order] // per_shard
                cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
                for i, j in zip(cuts[:-1], cuts[1:]):
                    held[int(shard[i])].append((slot[order[i:j]] - int(shard[i]) * per_shard, records[order[i:j]]))
                size += records.nbytes
                if size >= HOLD_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        whole: np.ndarray | None = None
        for batch in batches:
            for shard, places, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if whole is None:
                    whole = np.zeros(min(per_shard, total - shard * per_shard), layout)
                whole[np.frombuffer(places, "<i4")] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), layout)
        for i in range(0, 0 if whole is None else len(whole), 1024):
            part = whole[i : i + 1024]
            values = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((np.arange(len(part) + 1) * layout.itemsize).astype(np.int32)), pa.py_buffer(part.tobytes())])
            yield pa.RecordBatch.from_arrays([values], ["value"])

    dealt = cut.select("block", "place", "n", "records").mapInArrow(deal, "shard int, places binary, records binary")
    return dealt.repartitionById(shards, "shard").mapInArrow(assemble, "value binary").select(F.col("value").cast("string").alias("value"))


def sequence_table(cut: DataFrame, offsets: np.ndarray, total: int, key: int) -> DataFrame:
    """``(slot, doc_ids, doc_tokens)``: the documents of each sequence in their order, and how many tokens each has in it."""
    slots = slots_of(offsets, total, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            columns = [pa.array(np.concatenate(found) if found else [], pa.int64()), batch.column(3).flatten(), batch.column(4).flatten()]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "doc_ids", "doc_tokens"])

    return cut.select("block", "place", "n", "doc_ids", "doc_tokens").mapInArrow(run, "slot long, doc_ids array<long>, doc_tokens array<int>")


def write_shards(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, length: int = LENGTH, key: int = KEY, shard_bytes: tuple[int, int] = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents under ``path``: ``records`` (a file a shard), ``sequences`` (documents of each slot), ``about`` (the layout).

    The result depends on the rows and the parameters, not on their order or
    on the number of tasks.  Null and empty texts give an end token alone;
    texts of any length go on from sequence to sequence; rows that repeat are
    written as often as they occur; a null id is -1 in a header and null in a
    list; other columns are not read; an empty table gives no records.
    """
    spark = docs.sparkSession
    text_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    all_bytes = docs.agg(F.coalesce(F.sum(text_bytes), F.lit(0))).first()[0]
    blocks = min(max(1, -(-all_bytes // block_bytes)), MOST_BLOCKS)
    end = end_token(load_vocabulary(vocabulary))
    layout = record_dtype(length, id_type(end))
    stride = layout.itemsize + 1
    with scratch(spark):
        cut = staged(sequences(docs, blocks, vocabulary, length, key, id_col, text_col), "sequences")
        counts = np.zeros(blocks, np.int64)
        for r in cut.groupBy("block").agg(F.sum("n").alias("n")).collect():
            counts[r.block] = r.n
        total = int(counts.sum())
        offsets = np.cumsum(counts) - counts
        least, most = shard_bytes
        per_shard = max(1, min(max(least, total * stride // MANY_SHARDS), most) // stride)
        shards = max(1, -(-total // per_shard))
        records = written_records(cut, offsets, total, per_shard, shards, key, layout)
        records.write.option("lineSep", "\n").text(f"{path}/records")
        sequence_table(cut, offsets, total, key).write.parquet(f"{path}/sequences")
    about = [(length, layout["ids"].base.str, end, total, per_shard, key, vocabulary)]
    spark.createDataFrame(about, "length int, ids string, end_token int, records long, per_shard long, key long, vocabulary string").coalesce(1).write.parquet(f"{path}/about")


def read_from(spark: SparkSession, path: str, slot: int = 0, count: int | None = None) -> DataFrame:
    """Records of a written set from ``slot`` on, ``count`` of them or all: slot, shard, byte_offset, first_doc_id, first_token, n_tokens, ids (as bytes).

    Only the shards that hold these slots are read, one task a file; by the
    bound on their size a file fits a task.
    """
    about = spark.read.parquet(f"{path}/about").first()
    layout = np.dtype([*record_dtype(about.length, about.ids).descr, ("line_end", "u1")])
    past = about.records if count is None else min(about.records, slot + count)
    per_shard, slot = about.per_shard, max(slot, 0)
    shards = range(slot // per_shard, -(-past // per_shard)) if slot < past else range(0)
    shard = F.regexp_extract("path", r"part-(\d+)", 1).cast("int")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    files = files.where((F.col("length") > 0) & shard.between(shards.start, shards.stop - 1)).select(shard.alias("shard"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(content.as_buffer(), layout)
                base = number * per_shard
                for i in range(max(0, slot - base), min(len(found), past - base), 1024):
                    x = found[i : min(i + 1024, past - base)]
                    n = len(x)
                    nth = np.arange(i, i + n, dtype=np.int64)
                    width = layout["ids"].base.itemsize
                    columns = [
                        pa.array(base + nth),
                        pa.array(np.full(n, number, np.int32)),
                        pa.array(nth * layout.itemsize),
                        *(pa.array(np.ascontiguousarray(x[f])) for f in ("first_doc", "first_token", "n_tokens")),
                        pa.array([ids[: width * m] for ids, m in zip(map(np.ndarray.tobytes, x["ids"]), x["n_tokens"].tolist())], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["slot", "shard", "byte_offset", "first_doc_id", "first_token", "n_tokens", "ids"])

    return files.mapInArrow(run, "slot long, shard int, byte_offset long, first_doc_id long, first_token int, n_tokens int, ids binary")


def shard_report(spark: SparkSession, path: str) -> DataFrame:
    """All records of a written set as they are read back, with a hash of the ids and the documents in each."""
    records = read_from(spark, path).withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")
    return records.join(spark.read.parquet(f"{path}/sequences"), "slot")


def op10_token_shards(spark, sf_dir: str) -> DataFrame:
    # The result reads the shards, so they go with the scope or session that asked.
    path = owned(spark, new_path(spark, "token-shards"))
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return shard_report(spark, path)
