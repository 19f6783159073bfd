"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a skippable frame that
holds the seek table of its frames (the published seekable format), so any Zstandard reader can
decompress a bundle and a reader with the table can jump. An index maps each record identifier to
its bundle, its frame and its offset within the decompressed frame.

Payloads that occur more than once are stored once: the record of the smallest id is the response,
the others are ``revisit`` records that name it. Equality of payloads is equality of SHA-1 digest
and length. Only digests are shuffled to find them; the decisions come back by a join on the digest
whose small side holds nothing but repeated payloads.

Edge cases: a null payload is the empty payload; payloads under ``min_revisit_bytes`` are always
responses; rows that repeat the smallest id are all responses; a null id never is the smallest while
another id has that payload; a null or malformed URL is written as it is, with control characters
and spaces percent-encoded; an empty table gives no file and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import storage

# Fixed values of the Zstandard seekable format
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 48 << 20
_INDEX = "record_id long, record_type string, refers_to long, bundle string, frame int, frame_offset long, frame_bytes long, offset_in_frame long, record_bytes long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset_in_frame long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    target = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{record_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes):
    """(offset, length, WARC header, HTTP header, payload) of each record of a decompressed frame."""
    at = 0
    while at < len(frame):
        head_end = frame.index(b"\r\n\r\n", at)
        version, *lines = frame[at:head_end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        header = dict(line.split(": ", 1) for line in lines)
        block_start, n = head_end + 4, int(header["Content-Length"])
        block = frame[block_start : block_start + n]
        http, _, payload = block.partition(b"\r\n\r\n")
        http_header = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
        end = block_start + n + 4
        yield at, end - at, header, http_header, payload
        at = end


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer for frames of (compressed, decompressed) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame of an open bundle."""
    size = f.size()
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE:
        raise ValueError("not a seekable bundle")
    entry = 12 if flags & 0x80 else 8
    f.seek(size - 9 - n * entry)
    raw, out, at = f.read(n * entry), [], 0
    for k in range(n):
        compressed, plain = struct.unpack_from("<II", raw, k * entry)
        out.append((at, compressed, plain))
        at += compressed
    return out


def _id(urn: str | None) -> int | None:
    value = urn[len("<urn:page:") : -1] if urn else "None"
    return None if value == "None" else int(value)


def revisits(pages: DataFrame, *, id_col: str, payload_col: str, min_revisit_bytes: int) -> DataFrame:
    """digest, n_bytes, first_id of each payload that occurs more than once."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    keys = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n_bytes"))
    groups = keys.filter(F.col("n_bytes") >= min_revisit_bytes).groupBy("digest", "n_bytes").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return groups.filter("n > 1").drop("n")


def write_warc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 6) -> DataFrame:
    """Write bundles to the shared folder; returns the committed index."""
    spark = pages.sparkSession
    folder = storage.fresh_dir(spark, "warc")
    repeated = storage.materialize(revisits(pages, id_col=id_col, payload_col=payload_col, min_revisit_bytes=min_revisit_bytes), "warc-revisits")
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload"))
    decided = rows.join(repeated, ["digest", "n_bytes"], "left").select("id", "url", "payload", "first_id")

    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        compressor = zstandard.ZstdCompressor(level=level, write_checksum=True)
        stem, bundles = f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", 0
        frames: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        index: list[list] = []
        pending: list[bytes] = []
        in_frame = in_bundle = 0

        def close_frame():
            nonlocal in_frame, in_bundle
            if pending:
                frame = compressor.compress(b"".join(pending))
                for row in index[-len(pending) :]:
                    row[4:7] = len(frames), in_bundle, len(frame)
                frames.append(frame)
                sizes.append((len(frame), in_frame))
                in_bundle += len(frame)
                pending.clear()
                in_frame = 0

        def close_bundle():
            nonlocal bundles, in_bundle
            close_frame()
            path = storage.put_file(folder, f"{stem}-{bundles:04d}.warc.zst", [*frames, seek_table(sizes)])
            names = [c.split()[0] for c in _INDEX.split(", ")]
            for row in index:
                row[3] = path
            columns = list(zip(*index, strict=True))
            types = [pa.string() if n in ("record_type", "bundle") else pa.int32() if n == "frame" else pa.int64() for n in names]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            frames.clear(), sizes.clear(), index.clear()
            bundles, in_bundle = bundles + 1, 0
            return out

        for batch in batches:
            ids, urls, firsts = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for k, payload in enumerate(batch.column(2)):
                first = firsts[k]
                revisit = first is not None and first != ids[k]
                record = record_bytes(ids[k], urls[k], payload.as_py(), first, revisit, date)
                if in_frame and in_frame + len(record) > frame_bytes:
                    close_frame()
                index.append([ids[k], "revisit" if revisit else "response", first if revisit else None, None, None, None, None, in_frame, len(record)])
                pending.append(record)
                in_frame += len(record)
                if in_bundle >= bundle_bytes:
                    yield close_bundle()
        if index:
            yield close_bundle()

    return storage.materialize(decided.mapInArrow(run, _INDEX), "warc-index")


def read_warc(index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, read through their seek tables."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        reader = zstandard.ZstdDecompressor()
        names = [c.split()[0] for c in _RECORD.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]] for c in _RECORD.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with storage.open_file(path) as f:
                    for number, (at, compressed, plain) in enumerate(read_seek_table(f)):
                        f.seek(at)
                        rows = []
                        for offset, _, header, http, payload in parse_records(reader.decompress(f.read(compressed), max_output_size=plain)):
                            kind, digest = header["WARC-Type"], header["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "response" and payload_digest(payload) != digest:
                                raise ValueError(f"{path}: the payload of {header['WARC-Record-ID']} doesn't match its digest")
                            n = len(payload) if kind == "response" else int(http["Content-Length"])
                            rows.append((_id(header["WARC-Record-ID"]), header["WARC-Target-URI"], n, digest, kind, _id(header.get("WARC-Refers-To")), path, number, offset))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    bundles = index.select("bundle").distinct()
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bundles.repartition(tasks).mapInArrow(run, _RECORD)


def fetch_records(index: DataFrame, ids: DataFrame) -> DataFrame:
    """record_id, payload of single records: one jump to the frame, one to the offset in it. ``ids``
    has a column record_id; a revisit gives the payload of the response that it names."""
    wanted = ids.select("record_id").distinct().join(index, "record_id")
    target = wanted.select("record_id", F.coalesce("refers_to", "record_id").alias("target"))
    places = index.filter("record_type = 'response'").select(F.col("record_id").alias("target"), "bundle", "frame_offset", "frame_bytes", "offset_in_frame", "record_bytes")

    def run(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with storage.open_file(row["bundle"]) as f:
                    f.seek(row["frame_offset"])
                    frame = zstandard.ZstdDecompressor().decompress(f.read(row["frame_bytes"]))
                record = frame[row["offset_in_frame"] :][: row["record_bytes"]]
                out.append((row["record_id"], next(parse_records(record))[4]))
            if out:
                yield pa.RecordBatch.from_pydict({"record_id": pa.array([x[0] for x in out], pa.int64()), "payload": pa.array([x[1] for x in out], pa.binary())})

    return target.join(places, "target").mapInArrow(run, "record_id long, payload binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
