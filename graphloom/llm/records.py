"""Token ids as length-delimited binary records with masked checksums and a separate offset index."""

from __future__ import annotations

import contextlib
import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, estimated_bytes, filesystem, gathered, lean, scratch, table, writing
from .tokens import Encoder, default_path, with_end

_HEAD, _BODY = struct.Struct("<QI"), struct.Struct("<qB")


def masked(data) -> int:
    """CRC-32, rotated right by 15 bits plus a constant, so that a checksum of checksums stays sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """Length, its masked checksum, payload, its masked checksum; little-endian."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


class Truncated(ValueError):
    """A record that goes on behind the data."""


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload at ``at`` and where the next record starts. A damaged record raises ValueError, one that is cut off
    the kind Truncated."""
    if at + _HEAD.size > len(data):
        raise Truncated(f"record at {at} is cut off")
    length, check = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"record at {at}: wrong length checksum")
    if at + 16 + length > len(data):
        raise Truncated(f"record at {at} is cut off")
    payload = data[at + 12 : at + 12 + length]
    if masked(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
        raise ValueError(f"record at {at}: wrong checksum")
    return payload, at + 16 + length


def records_of(parts):
    """The payloads in a stream of bytes; no more of it than one block and one record is held."""
    held = b""
    for part in parts:
        data, at = memoryview(held + part if held else part), 0
        while at < len(data):
            try:
                payload, at = unframe(data, at)
            except Truncated:
                break
            yield payload
        held = bytes(data[at:])
    if held:
        raise Truncated("the last record is cut off")


def pack_ids(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """A record's payload: document, bytes an id (high bit: the document is null), ids."""
    return _BODY.pack(doc_id or 0, width | (0x80 if doc_id is None else 0)) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload) -> tuple[int | None, np.ndarray]:
    doc_id, width = _BODY.unpack_from(payload, 0)
    return None if width & 0x80 else doc_id, np.frombuffer(payload, f"<u{width & 0x7F}", offset=_BODY.size)


def write_records(docs: DataFrame, folder: str, end: int = 2, tokenizer: str | None = None, part_bytes: int = 256 << 20, slice_bytes: int = 20 << 20) -> list[dict]:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order to files part-N.rec with part-N.idx beside.

    Rows are range-partitioned by doc_id, then the hash of the text, into files of about ``part_bytes`` by the planner's
    estimate (at least as many as there are shuffle partitions), and sorted within; only then encoded, ``slice_bytes`` of
    text at a time, and framed straight into the file, so that no ids move or pile up. A file is named by its partition
    and appears by one rename: a task that runs again writes the same file.
    The index holds each record's byte offset and, last, the file's length, as unsigned 64-bit integers.
    Null doc_id comes first; null text is empty (the end id alone); equal doc_ids follow the text's hash, null first; an
    empty table writes no file. Returns the manifest: one dict for each file with its path, records and ids.
    """
    path = tokenizer or default_path()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-estimated_bytes(docs) // part_bytes)))

    def write(batches):
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        uri, n_records, n_ids, at = f"{folder}/part-{part:06d}", 0, 0, 0
        with contextlib.ExitStack() as files:
            out = None
            for piece in gathered(batches, "text", slice_bytes):
                if out is None:  # a partition without rows has no file
                    out, index = files.enter_context(writing(f"{uri}.idx", f"{uri}.rec"))[::-1]
                    index.write(struct.pack("<Q", 0))
                ids, counts = with_end(*encoder.encode(piece.column(1)), end)
                framed, offsets, first = bytearray(), [], 0
                for doc, n in zip(piece.column(0).to_pylist(), counts.tolist()):
                    framed += frame(pack_ids(doc, ids[first : first + n], encoder.width))
                    offsets.append(at + len(framed))
                    first += n
                out.write(framed)
                index.write(np.asarray(offsets, "<u8").tobytes())
                at, n_records, n_ids = offsets[-1], n_records + len(offsets), n_ids + first
        if n_records:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "path": [uri], "records": pa.array([n_records], pa.int64()), "ids": pa.array([n_ids], pa.int64())})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    order = ["doc_id", F.when(F.col("text").isNotNull(), F.col("h"))]
    sorted_docs = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = sorted_docs.mapInArrow(lean(write), "part bigint, path string, records bigint, ids bigint").collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: r["part"])]  # one row a file


def read_record(uri: str, numbers) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file by their numbers, in any order, by way of the index: only their bytes are read."""
    (where, path), (_, index) = filesystem(f"{uri}.rec"), filesystem(f"{uri}.idx")
    out = []
    with where.open_input_file(path) as f, where.open_input_file(index) as i:
        for number in numbers:
            i.seek(8 * int(number))
            start, stop = struct.unpack("<QQ", i.read(16))
            f.seek(start)
            out.append(unpack_ids(unframe(memoryview(f.read(stop - start)), 0)[0]))
    return out


def read_records(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens and ids_crc32 of each record, read from the files."""
    starts, files = 0, []
    for m in manifest:
        files.append((m["path"], starts))
        starts += m["ids"]
    shape = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not files:
        return spark.createDataFrame([], shape)

    def read(batches):
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns)):
                payloads = records_of(blocks(f"{uri}.rec"))
                while some := list(itertools.islice(payloads, 2000)):
                    rows = []
                    for payload in some:
                        doc, ids = unpack_ids(payload)
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(spark.sparkContext.parallelize(files, len(files)), "path string, start bigint").mapInArrow(lean(read), shape)


def op10_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents, read them back."""
    return read_records(spark, write_records(table(spark, sf_dir, "documents"), scratch(spark, "records")))
