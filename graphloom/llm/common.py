"""Shared helpers: tables, scratch folders, remote files, word splitting."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import hadoop, scratch, settle

__all__ = ["scratch", "settle"]

#: A word, as every contract here defines it: ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark's reader opens it, so any store works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to 2,000 rows, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def held_out(column: str = "doc_id", remainder: int = 0) -> Column:
    """crc32(id as text) mod 5 equals ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == remainder


def forget(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, so that its cleaner removes finished shuffle files. Listeners
    hold a query for a moment after its end, hence twice."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        time.sleep(0.4)
        spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, *uris: str) -> None:
    """Delete scratch tables whose every reader is itself a written table by now."""
    for uri in uris:
        fs, path = hadoop(spark, uri)
        fs.delete(path, True)


def filesystem(uri: str):
    """(filesystem, path) of a URI in shared storage, for raw files that Spark has no writer for."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes | bytearray | memoryview) -> None:
    """Write under a temporary name, then rename: a lost or repeated task never leaves half a file."""
    where, path = filesystem(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(temporary) as out:
        out.write(data)
    where.move(temporary, path)


@contextlib.contextmanager
def writing(*uris: str):
    """Streams to files that appear, in order, only when all is written: a lost or repeated task leaves no half file."""
    open_files = []
    try:
        for uri in uris:
            where, path = filesystem(uri)
            where.create_dir(os.path.dirname(path), recursive=True)
            temporary = f"{path}.{uuid.uuid4().hex}.tmp"
            open_files.append((where, temporary, path, where.open_output_stream(temporary)))
        yield [f[3] for f in open_files]
        for where, temporary, path, out in open_files:
            out.close()
            where.move(temporary, path)
    except BaseException:
        for where, temporary, _, out in open_files:
            out.close()
            with contextlib.suppress(OSError):
                where.delete_file(temporary)
        raise


def blocks(uri: str, size: int = 8 << 20):
    """A file's bytes, ``size`` at a time."""
    where, path = filesystem(uri)
    with where.open_input_stream(path) as f:
        while data := f.read(size):
            yield data


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's planner takes ``df`` to be, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def read_whole(uri: str) -> bytes:
    where, path = filesystem(uri)
    with where.open_input_stream(path) as f:
        return f.read()


def relieve() -> None:
    """Give memory that this worker no longer uses back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run):
    """A function over batches that gives memory back when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            relieve()

    return wrapped


def pieces(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Slices of a batch with about ``most`` bytes of ``column`` each; one very long text is a slice by itself."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def gathered(batches, column: str, most: int = 10 << 20):
    """Batches put together or cut until each has about ``most`` bytes of ``column``."""
    held: list[pa.RecordBatch] = []
    total = 0

    def flush():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]

    for batch in batches:
        for part in pieces(batch, column, most):
            size = part.column(part.schema.get_field_index(column)).nbytes
            if held and total + size > most:
                yield flush()
                held, total = [], 0
            if part.num_rows:
                held.append(part)
                total += size
    if held:
        yield flush()


def words_of(texts: pa.Array, lower: bool = True):
    """(codes, bounds, words): each text's words as codes into ``words``, text i at bounds[i]:bounds[i + 1]. Null: empty."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = split.flatten()
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), out=bounds[1:])
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # what stands beside leading and trailing white space
        keep = ~empty[codes] if len(codes) else np.zeros(0, bool)
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return codes, bounds, words


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
