"""Packing into fixed windows by best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, lean, settle, table
from .tokens import Encoder, default_path, with_end

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, text_hash bigint"


class Windows:
    """Open windows by remaining capacity: leaf c of a segment tree counts those with c tokens left."""

    def __init__(self, size: int):
        self.size, self.base = size, 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, window: int, left: int) -> None:
        self.open[left].append(window)
        i = self.base + left
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(window, its capacity) of the tightest window with room for ``length``, taken out of the tree."""
        count, i = self.count, self.base + length
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to the first right sibling that holds a window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if count[2 * i] else 2 * i + 1
        left = i - self.base
        while i:
            count[i] -= 1
            i >>= 1
        return self.open[left].pop(), left


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each item, longest items first, and the number of windows. Ties keep the given order."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, n = Windows(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take(length) if length < size else None
        if found is None:
            found, n = (n, size), n + 1
        window[i], offset[i] = found[0], size - found[1]
        if found[1] > length:
            tree.put(found[0], found[1] - length)
    return window, offset, n


def padded_length(used: np.ndarray, size: int) -> np.ndarray:
    """How long sequences are: ``size``, but those whose ids are a power of two in number are not padded."""
    return np.where(used & (used - 1) == 0, used, size)


def cut_pieces(docs: DataFrame, size: int, end: int, path: str, slice_bytes: int = 10 << 20) -> DataFrame:
    """Each document's ids and ``end``, cut into full windows and what is left, as digests (no ids move)."""

    def cut(batches):
        encoder = Encoder.of(path)
        for part in gathered(batches, "text", slice_bytes):
            ids, counts = with_end(*encoder.encode(part.column(1)), end)
            data, rows, at = memoryview(ids.astype("<u4").tobytes()), [], 0
            for doc, text_hash, n in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), counts.tolist()):
                for start in range(0, n, size):
                    length = min(size, n - start)
                    rows.append((doc, start, length, zlib.crc32(data[4 * (at + start) : 4 * (at + start + length)]), n, text_hash))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_hash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(cut), PIECES)


def pack(docs: DataFrame, size: int = 2048, end: int = 1, tokenizer: str | None = None, shard_pieces: int = 2048, slice_bytes: int = 10 << 20) -> DataFrame:
    """Pack whole documents (doc_id, text) into sequences of at most ``size`` tokens.

    A document's ids with ``end`` behind them are cut into full windows and one shorter rest. Pieces are dealt by hash
    into shards of about ``shard_pieces``, whatever the document, and each shard is packed by itself: the longest
    piece first, always into the window with the least room that is enough. A shard leaves a window or two half full.
    Null text is empty (one piece, the end id); repeated rows are packed as often as they come; an empty table gives an
    empty result; other columns are ignored. sequence_id is shard * 2^32 + the window's number there; doc_id and
    text_hash say whose ids a piece holds (rows equal in both are equal, so any of them fills any of their places).
    padded is how long the piece's sequence is when it is written: ``size``, but where its ids are a power of two in
    number it ends with them. ``slice_bytes`` of text are encoded at a time.
    """
    cut = settle(cut_pieces(docs, size, end, tokenizer or default_path(), slice_bytes), "pack-pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("text_hash", "ascending")])
        length = rows["length"].to_numpy()
        window, offset, n = best_fit(length, size)
        padded = padded_length(np.bincount(window, weights=length, minlength=n).astype(np.int64), size)[window]
        return rows.drop_columns("shard").append_column("sequence_id", pa.array((key[0].as_py() << 32) + window)).append_column("offset", pa.array(offset)).append_column("padded", pa.array(padded))

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(place, PIECES + ", sequence_id bigint, offset bigint, padded bigint")


def sequences(docs: DataFrame, packed: DataFrame, size: int = 2048, end: int = 1, tokenizer: str | None = None) -> DataFrame:
    """The sequences themselves (sequence_id, ids) of ``docs`` and what ``pack`` says of them with the same options.

    Each text of a doc_id is encoded again once; its pieces go to all their places (rows may share doc_id or be equal;
    doc_id and text may be null). Behind them sequences are filled with 0 up to ``size``, but those whose ids are a power
    of two in number, which end there. Pieces that are not those packed are an error.
    """
    path = tokenizer or default_path()

    def spread(batches):
        encoder = Encoder.of(path)
        for part in gathered(batches, "text"):
            ids, counts = with_end(*encoder.encode(part.column(1)), end)
            rows, at = [], 0
            for doc, text_hash, n in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), counts.tolist()):
                for start in range(0, n, size):
                    own = ids[at + start : at + min(start + size, n)].astype("<u4")
                    rows.append((doc, text_hash, start, zlib.crc32(own.tobytes()), own))
                at += n
            doc, text_hash, start, crc, own = zip(*rows)
            arrays = [pa.array(c, pa.int64()) for c in (doc, text_hash, start, crc)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(own, pa.list_(pa.int32()))], ["of", "of_text", "at", "crc", "ids"])

    once = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).dropDuplicates(["doc_id", "text_hash"])
    pieces = once.mapInArrow(lean(spread), "of bigint, of_text bigint, at bigint, crc bigint, ids array<int>")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text")) & (F.col("start") == F.col("at"))
    alike = F.when(F.col("ids_crc32") == F.col("crc"), F.col("ids")).otherwise(F.raise_error(F.lit("a packed piece is not one of these documents")))
    spread_out = packed.join(pieces, same, "left").select("sequence_id", "offset", "padded", alike.alias("ids"))
    whole = spread_out.groupBy("sequence_id", "padded").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(0), (F.col("padded") - F.size("ids")).cast("int"))).alias("ids"))


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of all documents."""
    return pack(table(spark, sf_dir, "documents"), slice_bytes=20 << 20)
