"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import bisect
import heapq
import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, lean, settle, table

_SPANS = "array<struct<first:bigint,last:bigint,times:int>>"


def apportion(claims: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> np.ndarray:
    """Seats by highest quotients claim / (2a + 1), none beyond its cap; ties go to the earlier claim.

    The divisor that hands out almost all seats is found by bisection, the last few go one by one from a heap, which
    gives the same seats as handing out all of them singly. Claims of 0 get none.
    """
    w = np.asarray(claims, float)
    most = np.full(len(w), np.iinfo(np.int64).max // 4) if caps is None else np.asarray(caps, np.int64)
    most = np.where(w > 0, most, 0)
    seats = int(min(seats, most.sum(dtype=object))) if len(w) else 0
    given = lambda d: np.minimum(most, np.floor(w / d + 0.5 - 1e-9)).astype(np.int64)
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    low, high = 0.0, 2.0 * w.max() + 1.0  # a divisor beyond twice the largest claim gives no seat
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or mid in (low, high):
            break
        low, high = (mid, high) if given(mid).sum() > seats else (low, mid)
    a = given(high)
    heap = [(-w[i] / (2 * a[i] + 1), i) for i in range(len(w)) if a[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(a.sum())):
        _, i = heapq.heappop(heap)
        a[i] += 1
        if a[i] < most[i]:
            heapq.heappush(heap, (-w[i] / (2 * a[i] + 1), i))
    return a


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = 3) -> list[float]:
    """Share the sum of sizes by weight; what lies above cap times a size is shared again among the rest."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        share = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / share > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = total * weights[i] / share
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        total -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def shares(seats: int, words: int, sizes: np.ndarray, block: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, words) of each part of a whole that takes ``seats`` blocks, ``words`` words in all: blocks by highest
    quotients of the parts' sizes; what blocks of ``block`` words lack or have too much, the first parts that can make
    up. No part takes more than cap times its size."""
    sizes = np.asarray(sizes, np.int64)
    blocks = apportion(sizes, seats, cap * sizes // block)
    own = blocks * block
    over = words - int(own.sum())
    room = cap * sizes - own if over > 0 else own
    own = own + np.sign(over) * np.diff(np.minimum(np.cumsum(room), abs(over)), prepend=0)
    return blocks, own


def _deal(block: int, cap: int, name: str):
    """The shares of the parts ``name`` of each whole."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name, ignore_index=True)
        seats, quota = shares(int(pdf["seats"][0]), int(pdf["quota"][0]), pdf["words"].to_numpy(), block, cap)
        return pd.DataFrame({"sid": pdf["sid"], name: pdf[name], "seats": seats, "quota": quota})

    return deal


def chosen(words: int, quota: int, block: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(edges, times): how often the runs of a text of ``words`` words are taken, ``quota`` words in all. Every block is
    taken as often as all of them can be; a permutation says which are taken once more, the last of them in part."""
    times, rest = divmod(quota, words)
    edges = np.append(np.arange(0, words, block), words)
    order = rng.permutation(len(edges) - 1)
    upto = np.cumsum(np.diff(edges)[order])
    n = int(np.searchsorted(upto, rest, "right"))
    often = np.full(len(order), times, np.int64)
    often[order[:n]] += 1
    if left := rest - (int(upto[n - 1]) if n else 0):
        i = int(order[n])
        edges, often = np.insert(edges, i + 1, edges[i] + left), np.insert(often, i, times + 1)
    return edges, often


def _select(seed: int, block: int, spans: bool):
    def select(key: tuple, rows: pa.Table) -> pa.Table:
        sid, shard = (k.as_py() for k in key)
        rows = rows.sort_by([("oid", "ascending"), ("hash", "ascending")])
        size = rows["size"].to_numpy()
        ends = np.cumsum(size)
        starts, total = ends - size, int(ends[-1])
        quota = int(rows["quota"][0].as_py() or 0)
        taken, found = np.zeros(len(size), np.int64), [[]] * len(size)
        if quota and total:
            edges, times = chosen(total, quota, block, np.random.default_rng([seed, sid, shard]))
            n = len(times)
            sums = np.concatenate([[0], np.cumsum(times * np.diff(edges))])

            def upto(x):
                i = np.minimum(np.searchsorted(edges, x, "right") - 1, n - 1)
                return sums[i] + (x - edges[i]) * times[i]

            taken = upto(ends) - upto(starts)
            if spans:
                cut = np.concatenate([[0], np.flatnonzero(np.diff(times)) + 1])  # runs of blocks that are taken equally often
                at, often = edges[cut].tolist(), times[cut].tolist()
                till = [*at[1:], total]
                found = []
                for s, e in zip(starts.tolist(), ends.tolist()):
                    i, j = bisect.bisect_right(till, s), bisect.bisect_left(at, e)
                    found.append([{"first": max(at[k], s) - s, "last": min(till[k], e) - s, "times": often[k]} for k in range(i, j) if often[k]] if e > s else [])
        out = {"row" if spans else "doc_id": rows["row" if spans else "doc_id"], "size": rows["size"], "sid": rows["sid"], "taken": pa.array(taken, pa.int64())}
        if spans:
            out["spans"] = pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("times", pa.int32())])))
        return pa.table(out)

    return select


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, block_words: int = 2048, shard_words: int = 1 << 20,
        shards_a_group: int = 4096, seed: int = 17, max_sources: int = 1_000_000, spans: bool = False) -> DataFrame:
    """Say how many words of each document a mix of ``docs`` (doc_id, text, source) takes.

    Sources, by code point with null last, weigh ``weights`` in turn. Sainte-Laguë apportionment hands out blocks of
    ``block_words`` words, the same in all sources, by the sources' targets; one block of a source is cut, or added in
    part, so that it takes its target to the word (without that, a source of a few blocks would miss it widely). A
    source's blocks are handed on by size to groups of shards and to their shards of about ``shard_words`` words, dealt
    by the hash of doc_id and the text, so that a source with a third of all rows is as many tasks as it needs and no
    task sees more than ``shards_a_group`` shards. A shard's text in doc_id order is cut into blocks, and a seeded
    permutation picks them. No word is taken more than ``cap`` times, so no document is.

    Only one row for each source comes to the driver; more than ``max_sources`` sources are an error, not a cut.
    Null text has size 0; documents of size 0 are taken 0 times; repeated rows count as documents of their own; an empty
    table gives an empty result; other columns are ignored. Returns doc_id, size, source_size, target, taken; with
    ``spans`` also source and row (all columns of ``docs``) and the runs [first, last) of words with their times.
    """
    spark = docs.sparkSession
    n_words = F.coalesce(F.expr(rf"regexp_count(text, '{WORD.replace(chr(92), chr(92) * 2)}')"), F.lit(0)).cast("long")
    order = (F.col("doc_id").cast("long").alias("oid"), F.xxhash64("text").alias("hash"))
    sized = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if spans else [F.col("doc_id").cast("long").alias("doc_id")]), "source", n_words.alias("size"), *order)
    if not spans:
        sized = settle(sized, "mix-sizes")  # a few bytes a document, read three times
    sums = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    size = [int(r["words"] or 0) for r in sums]
    target = targets(size, [weights[i % len(weights)] for i in range(len(sums))], cap)
    seats = apportion(target, round(sum(target) / block_words), [cap * w // block_words for w in size])
    known = spark.createDataFrame(
        [(i, r["source"], size[i], target[i], int(seats[i]), round(target[i]), max(1, math.ceil(size[i] / shard_words))) for i, r in enumerate(sums)],
        "sid int, of string, source_size bigint, target double, seats bigint, quota bigint, shards bigint",
    )
    placed = sized.join(known.select("sid", "of", "shards"), F.col("source").eqNullSafe(F.col("of"))).withColumn("shard", F.expr("pmod(xxhash64(oid, hash), shards)"))
    shards = settle(placed.groupBy("sid", "shard").agg(F.sum("size").alias("words")).withColumn("part", F.expr(f"shard div {shards_a_group}")), "mix-shards")
    parts = shards.groupBy("sid", "part").agg(F.sum("words").alias("words")).join(known.select("sid", "seats", "quota"), "sid")
    dealt = parts.groupBy("sid").applyInPandas(_deal(block_words, cap, "part"), "sid int, part bigint, seats bigint, quota bigint")
    plan = shards.join(dealt, ["sid", "part"]).groupBy("sid", "part").applyInPandas(_deal(block_words, cap, "shard"), "sid int, shard bigint, seats bigint, quota bigint")
    rows = placed.select(*(["row"] if spans else ["doc_id"]), "size", "oid", "hash", "sid", "shard").join(plan.select("sid", "shard", "quota"), ["sid", "shard"])
    shape = StructType([sized.schema["row" if spans else "doc_id"], *StructType.fromDDL("size bigint, sid int, taken bigint" + (f", spans {_SPANS}" if spans else ""))])
    taken = rows.groupBy("sid", "shard").applyInArrow(_select(seed, block_words, spans), shape)
    return taken.join(known.select("sid", "source_size", "target"), "sid").drop("sid")


def _cut(text: str | None, spans, layer: int) -> list[str]:
    """The texts of the runs taken at least ``layer`` times, each from its first word to the start of the next run."""
    at = [m.start() for m in re.finditer(WORD, text or "")]
    runs: list[list[int]] = []
    for s in spans:
        if s["times"] >= layer:
            if runs and runs[-1][1] == s["first"]:
                runs[-1][1] = s["last"]
            else:
                runs.append([s["first"], s["last"]])
    return [text[0 if a == 0 else at[a] : at[b] if b < len(at) else len(text)] for a, b in runs]


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each run of words that is taken, as a row of its own, as often as
    it is taken (a text taken whole twice is two equal rows); n_chars, if there, is the run's length."""
    shape = docs.schema
    has_length = "n_chars" in docs.columns

    def cut(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for layer in range(1, max([0, *(s["times"] for s in r["spans"])]) + 1):
                    for text in _cut(r["row"]["text"], r["spans"], layer):
                        out.append(r["row"] | {"text": text} | ({"n_chars": len(text)} if has_length else {}))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return mix(docs, spans=True, **options).select("row", "spans").mapInArrow(lean(cut), shape)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
