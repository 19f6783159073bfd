"""Sequence packing by shortest-pack-first over the length histogram.

Documents are encoded, closed by an end id and cut into pieces of at most ``max_len`` ids. Only the
histogram of piece lengths (at most ``max_len`` counters, whatever the corpus) reaches the driver.
There lengths are placed longest first, each into the shortest open packs that still have room;
packs are never listed one by one but as patterns with counts. Pieces then find their slot by their
rank among the pieces of their length, so no piece, and no id, is moved for the packing.

A document longer than ``max_len`` gives full pieces, in order, and one remainder.

Edge cases: a null or empty text is the end id alone; repeated documents are packed each on their
own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import storage
from .tokens import encoder

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = f"{_PIECES}, sequence_id long, offset long, sequence_tokens long"


def pack_histogram(counts: dict[int, int], max_len: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns as (number of packs, lengths in order of offset).

    Lengths are taken longest first; the pieces of a length go to the packs with most room, as long
    as it suffices, and open new packs otherwise. A step exhausts either the pieces of the length or
    the packs of a pattern."""
    rooms: list[int] = []  # ascending, rooms that have open packs
    open_packs: dict[int, list[list]] = defaultdict(list)  # room -> [count, chain of lengths]

    def put(room: int, count: int, chain) -> None:
        if room not in open_packs or not open_packs[room]:
            at = bisect_left(rooms, room)
            if at == len(rooms) or rooms[at] != room:
                rooms.insert(at, room)
        open_packs[room].append([count, chain])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pack = open_packs[room][-1]
                take = min(left, pack[0])
                chain = (length, pack[1])
                pack[0] -= take
                if not pack[0]:
                    open_packs[room].pop()
                    if not open_packs[room]:
                        rooms.pop()
                put(room - length, take, chain)
            else:
                take = left
                put(max_len - length, take, (length, None))
            left -= take
    patterns = []
    for room in sorted(open_packs):
        for count, chain in open_packs[room]:
            lengths = []
            while chain:
                lengths.append(chain[0])
                chain = chain[1]
            patterns.append((count, tuple(reversed(lengths))))
    return patterns


def slot_table(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """Length -> rows (first rank, first sequence, offset, tokens of the sequence), by first rank."""
    slots, taken, sequence = defaultdict(list), defaultdict(int), 0
    for count, lengths in patterns:
        offset, total = 0, sum(lengths)
        for length in lengths:
            slots[length].append((taken[length], sequence, offset, total))
            taken[length] += count
            offset += length
        sequence += count
    return {k: np.array(v, dtype=np.int64) for k, v in slots.items()}


def token_pieces(docs: DataFrame, vocabulary: str, *, end_id: int, max_len: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def run(batches):
        import pyarrow as pa

        enc, end = encoder(vocabulary), struct.pack("<I", end_id)
        for whole in batches:
            for batch in storage.batch_slices(whole, "text"):
                rows = [[], [], [], [], []]
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = enc.ids(text.as_py()) + end
                    n = len(ids) // 4
                    for start in range(0, n, max_len):
                        piece = ids[4 * start : 4 * (start + max_len)]
                        for column, value in zip(rows, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)


def pack(pieces: DataFrame, max_len: int) -> DataFrame:
    """Place ``pieces`` (with a ``length`` of 1 to max_len): their columns, sequence_id, offset and
    sequence_tokens (ids in that sequence, the rest being padding)."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a total order, so that a length that very many pieces have spreads over partitions
    ordered = pieces.repartitionByRange(parts, "length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start")
    ordered = storage.materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "packing-order")
    # at most one row for each length and one more for each partition
    runs = sorted((r.part, r.length, r.first, r.n) for r in ordered.groupBy(F.shiftright("_at", 33).alias("part"), "length").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect())
    counts: dict[int, int] = defaultdict(int)
    first_rank = {}
    for part, length, first, n in runs:
        first_rank[part, length] = (first, counts[length])
        counts[length] += n
    slots = slot_table(pack_histogram(counts, max_len))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, at = (batch.column(c).to_numpy() for c in ("length", "_at"))
            placed = np.empty((3, batch.num_rows), dtype=np.int64)
            for part, size in set(zip((at >> 33).tolist(), length.tolist(), strict=True)):
                rows = np.flatnonzero(((at >> 33) == part) & (length == size))
                first, base = first_rank[part, size]
                rank, table = at[rows] - first + base, slots[size]
                hit = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
                placed[:, rows] = hit[:, 1] + rank - hit[:, 0], hit[:, 2], hit[:, 3]
            columns = {c: batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            yield pa.RecordBatch.from_pydict(columns | dict(zip(("sequence_id", "offset", "sequence_tokens"), map(pa.array, placed), strict=True)))

    return ordered.mapInArrow(run, _PLACED)


def pack_documents(docs: DataFrame, vocabulary: str, *, end_id: int = 1, max_len: int = 2048, **columns) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens."""
    return pack(storage.materialize(token_pieces(docs, vocabulary, end_id=end_id, max_len=max_len, **columns), "packing-pieces"), max_len)


def op3_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
