"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding.

A file holds the documents of one block, in ascending doc_id order. Its ids are replaced by their
frequency rank among all ids of the block (ties: smaller id first), so frequent ids fit one byte.
Every rank takes one or two bytes, or up to four where the block has more than 65,536 different
ids; the lengths stand apart, in control bytes, so the reader finds all positions of a block with
one table lookup for each control byte and decodes without a loop over ids.

File format, little-endian::

    magic 'TWT1' | u32 code bits (1 or 2) | u32 n_docs | u32 n_ids_distinct | u64 n_ids | u64 n_data_bytes
    n_ids_distinct u32: id of each rank
    n_docs i64 doc_id, n_docs u32 number of ids with the end id
    control bytes: 8 codes of 1 bit or 4 codes of 2 bits each, first code lowest; code = length - 1
    data bytes: ranks, low byte first

Edge cases: a null or empty text is the end id alone; equal doc_ids stay separate rows, in any
order among themselves; an empty table gives no file and no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import storage
from .tokens import encoder

_MAGIC = b"TWT1"
_HEAD = struct.Struct("<4sIIIQQ")
#: Ids a block gathers before it is written.
BLOCK_IDS = 4_000_000
_MANIFEST = "shard int, block int, path string, first_doc long, n_docs long, n_ids long"
_DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, block int, pos int"


def encode_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """Chunks of one file."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, dtype=np.int64)
    present = np.flatnonzero(counts)
    table = present[np.lexsort((present, -counts[present]))].astype("<u4")
    rank_of = np.zeros(len(counts), dtype=np.uint32)
    rank_of[table] = np.arange(len(table), dtype=np.uint32)
    ranks = rank_of[ids]
    bits = 1 if len(table) <= 1 << 16 else 2
    codes = np.zeros(len(ranks), dtype=np.uint8)
    for k in range(1, 1 << bits):
        codes += ranks >= (1 << (8 * k))
    per = 8 // bits
    padded = np.zeros(-(-len(codes) // per) * per, dtype=np.uint8)
    padded[: len(codes)] = codes
    control = np.zeros(len(padded) // per, dtype=np.uint8)
    for k in range(per):
        control |= padded[k::per] << (bits * k)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[:, : 1 << bits][np.arange(1 << bits) <= codes[:, None]]
    head = _HEAD.pack(_MAGIC, bits, len(doc_ids), len(table), len(ranks), len(data))
    return [head, table.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), control.tobytes(), data.tobytes()]


def _tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each control byte: the lengths of its codes, and their sum."""
    per, control = 8 // bits, np.arange(256)
    lengths = np.stack([((control >> (bits * k)) & ((1 << bits) - 1)) + 1 for k in range(per)], axis=1).astype(np.int64)
    return lengths, lengths.sum(axis=1)


def decode_block(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths, ids of a file."""
    magic, bits, n_docs, n_table, n_ids, n_data = _HEAD.unpack_from(blob)
    if magic != _MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    table = np.frombuffer(blob, "<u4", n_table, at)
    doc_ids = np.frombuffer(blob, "<i8", n_docs, at := at + 4 * n_table)
    doc_lengths = np.frombuffer(blob, "<u4", n_docs, at := at + 8 * n_docs)
    n_control = -(-n_ids // (8 // bits))
    control = np.frombuffer(blob, np.uint8, n_control, at := at + 4 * n_docs)
    data = np.frombuffer(blob, np.uint8, n_data, at + n_control)
    lengths = _tables(bits)[0][control].reshape(-1)[:n_ids]
    ends = np.cumsum(lengths)
    ranks = data[ends - lengths].astype(np.uint32)
    for k in range(1, 1 << bits):
        longer = np.flatnonzero(lengths > k)
        ranks[longer] |= data[ends[longer] - lengths[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return doc_ids, doc_lengths, table[ranks]


def _writer(vocabulary: str, end_id: int, folder: str, block_ids: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, block, enc, end = TaskContext.get().partitionId(), 0, encoder(vocabulary), struct.pack("<I", end_id)
        doc_ids, parts, held = [], [], 0

        def flush():
            lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            ids = np.frombuffer(b"".join(parts), "<u4")
            keys = np.array(doc_ids, dtype=np.int64)
            path = storage.put_file(folder, f"shard-{shard:06d}-{block:06d}-{TaskContext.get().taskAttemptId()}.twt", encode_block(keys, lengths, ids))
            row = {"shard": [shard], "block": [block], "path": [path], "first_doc": [doc_ids[0]], "n_docs": [len(keys)], "n_ids": [len(ids)]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                coded = enc.ids(text.as_py()) + end
                doc_ids.append(doc_id)
                parts.append(coded)
                held += len(coded) // 4
                if held >= block_ids:
                    yield flush()
                    doc_ids, parts, held, block = [], [], 0, block + 1
        if doc_ids:
            yield flush()

    return run


def write_token_files(docs: DataFrame, vocabulary: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text and write block files; returns the committed manifest, one row a file
    (shard, block, path, first_doc, n_docs, n_ids). (shard, block) follows ascending ids."""
    spark = docs.sparkSession
    folder = storage.fresh_dir(spark, "token-files")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    return storage.materialize(ordered.mapInArrow(_writer(vocabulary, end_id, folder, block_ids), _MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and
    where the document lies (shard, block, pos)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, block, path, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "block", "path", "start")), strict=True):
                with storage.open_file(path) as f:
                    doc_ids, lengths, ids = decode_block(f.read())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw, n = memoryview(ids.astype("<u4").tobytes()), len(doc_ids)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.astype(np.int64)), pa.array(ends - lengths + first), pa.array(lengths.astype(np.int64)), pa.array(np.array(crc, dtype=np.int64)), pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n, dtype=np.int32))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "block", "pos"],
                )

    # offsets of blocks: within a shard by a window over its blocks, between shards by a running sum
    # over one row for each shard (as many rows as there are partitions)
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = manifest.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    running = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = totals.select("shard", F.coalesce(F.sum("shard_ids").over(running), F.lit(0)).alias("shard_start"))
    block_start = F.coalesce(F.sum("n_ids").over(within), F.lit(0))
    files = manifest.select("shard", "block", "path", block_start.alias("block_start")).join(shards, "shard").select("shard", "block", "path", (F.col("shard_start") + F.col("block_start")).alias("start"))
    tasks = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.repartition(tasks, "path").mapInArrow(run, _DECODED)


def op8_token_binary(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
