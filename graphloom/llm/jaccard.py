"""Exact Jaccard join over word shingles: size-banded tiles, bitmap signatures, sorted-array intersection.

Linked sets A and B differ in at most (|A| + |B|) / 9 shingles (for a similarity of 0.8). Sizes are banded by that
similarity, so linked sets lie in one band or in neighbours, and each set goes to the tiles of its own band and the next.
A band cuts the space of shingle hashes into more buckets than two of its linked sets can differ in, so they agree in a
whole bucket: a tile is the sets of a band with equal shingles in a bucket. Tiles lose no link, and sets that only share
a popular passage hardly ever meet, as a bucket's shingles come from all over a text.

Within tiles, sets are first held against one or two pivots each; what that links is one component. Only where a tile
still spans components are all pairs across them compared. Either way bitmaps of hashed shingles bound the overlap from
above by bit counts, and only pairs that pass fetch their texts for the exact intersection.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, hashes, lean, mixed, pieces, relieve, settle, table, words_of
from .graphs import components
from .tokens import ragged

_M = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a signature that go to a tile; equal ones by chance only cost a comparison.
_SIG = 5
#: Entries for a task that finds tiles, and documents' bytes from which a task makes entries at a time.
ENTRIES, CHUNK = 3_000_000, 12 << 20
#: Members of open tiles for a task that compares across components.
MEMBERS = 20_000


class Bands:
    """Sizes from low[t] on are in band t. buckets[t]: more than sets of tile t can differ in, and some more, so that
    agreement in an empty bucket, which all small sets share, is never needed (``spare``)."""

    def __init__(self, threshold: Fraction):
        self.threshold = threshold
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] / threshold)))
        self.edges = np.asarray(self.low, np.int64)
        self.buckets, self.spare = [], []
        for t in range(len(self.low) - 1):
            differ = math.floor(2 * (self.low[t + 1] - 1) * (1 - threshold) / (1 + threshold))
            self.spare.append(1 + math.ceil(0.12 * (differ + 1)) if differ else 0)
            self.buckets.append(differ + 1 + self.spare[-1] if differ else 0)

    def of(self, n) -> np.ndarray:
        return np.searchsorted(self.edges, n, "right") - 1

    def bits(self, t: int, fine: bool = False) -> int:
        """Width of a bitmap: coarse ones go with pairs, fine ones (a tighter bound) only to tiles that stay open."""
        return max(64, 1 << ((6 if fine else 2) * self.low[t] - 1).bit_length())


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: k words in a row; of fewer words, all of them as one."""
    codes, bounds, words = words_of(texts)
    h = hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        if len(h) >= k:
            rolled = h[: len(h) - k + 1].copy()
            for j in range(1, k):
                rolled = mixed(rolled * _M + h[j : len(h) - k + 1 + j])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                x = np.asarray([b - a], np.uint64)
                for j in range(a, b):
                    x = mixed(x * _M + h[j : j + 1])
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), len(s)))))


def bitmap(s: np.ndarray, width: int) -> bytes:
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap as 64-bit words, folded to ``width`` bits."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 64 > width:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def bound(a: np.ndarray, n_a, b: np.ndarray, n_b) -> np.ndarray:
    """At most so many shingles are in both: every bit that only one side has stands for a shingle that only it has."""
    only_a = np.bitwise_count(a & ~b).sum(-1, dtype=np.int64)
    only_b = np.bitwise_count(b & ~a).sum(-1, dtype=np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def linked(overlap, n_a, n_b, threshold: Fraction):
    """overlap / union >= threshold, in whole numbers."""
    return threshold.denominator * overlap >= threshold.numerator * (n_a + n_b - overlap)


def signatures(s: np.ndarray, t: int, bands: Bands) -> np.ndarray:
    """A hash of the shingles in each bucket of tile band t; of empty buckets only where too many are empty."""
    k = bands.buckets[t]
    with np.errstate(over="ignore"):
        x = mixed(s + np.uint64(t + 1) * _M)
        bucket = ((x >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if k < 1 << 16 else bucket, kind="stable")
        bucket, x = bucket[order], x[order]
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        have = bucket[first]
        sums = np.add.reduceat(mixed(x), first)
        sums = mixed(sums + (have.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(t))
        if k - len(have) > bands.spare[t]:
            empty = np.setdiff1d(np.arange(k), have).astype(np.uint64)
            sums = np.concatenate([sums, mixed((empty + np.uint64(1)) * np.uint64(0xCA5A826395121157) + np.uint64(t))])
    return sums


def _sets(docs: DataFrame, bands: Bands, k: int) -> DataFrame:
    """doc_id, h, sid (name of the set; null if empty), n_shingles, coarse bits and fine of each document (doc_id, h, text)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                found = shingle_sets(part.column(2), k)
                n = [len(s) for s in found]
                sid = [set_id(s) if len(s) else None for s in found]
                bits, fine = ([bitmap(s, bands.bits(int(bands.of(len(s))), wide)) if len(s) else None for s in found] for wide in (False, True))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(fine, pa.binary())], ["doc_id", "h", "sid", "n_shingles", "bits", "fine"])

    return docs.select("doc_id", "h", "text").mapInArrow(lean(run), "doc_id bigint, h bigint, sid bigint, n_shingles bigint, bits binary, fine binary")


def _entries(docs: DataFrame, bands: Bands, k: int, parts: int) -> DataFrame:
    """For each task that finds tiles: the signatures and sets of the documents here, in one packed row a chunk."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", CHUNK):
                sids, sigs, own, sizes = [], [], [], []
                seen = set()
                for s in shingle_sets(part.column(1), k):
                    if not len(s) or (name := set_id(s)) in seen:
                        continue
                    seen.add(name)
                    band = int(bands.of(len(s)))
                    for t in (band, band + 1):
                        if bands.buckets[t]:
                            found = signatures(s, t, bands)
                            sigs.append(found)
                            own.append(np.full(len(found), len(sids), np.int64))
                    sids.append(name)
                    sizes.append(len(s))
                if not sigs:
                    continue
                sig, of = np.concatenate(sigs), np.concatenate(own)
                to = ((sig >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
                order = np.argsort(to * len(sids) + of, kind="stable")
                sig, of, to = sig[order], of[order], to[order]
                name, size = np.asarray(sids, np.int64), np.asarray(sizes, np.uint32)
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                rows = []
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)]):
                    first = np.flatnonzero(np.diff(of[a:b], prepend=-1))
                    who, count = of[a:b][first], np.diff(np.append(first, b - a)).astype(np.uint32)
                    low = sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SIG]
                    rows.append((int(to[a]), np.asarray([len(who)], "<u4").tobytes() + name[who].tobytes() + size[who].tobytes() + count.tobytes() + low.tobytes()))
                p, payload = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(payload, pa.binary())], ["part", "payload"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "part bigint, payload binary")


def _tiles(key: tuple, rows: pa.Table) -> pa.Table:
    """What meets in tiles of at least two different sets. Rows not ``open``: a pair (x, y) of a set and one of the
    tile's pivots, the two of its sets whose hashes come first (so mostly the same two in all tiles of a group). Rows
    ``open``: tile x also has set y, of n shingles, and others that are no pivots."""
    relieve()
    sids, sizes, sigs = [], [], []
    for data in rows["payload"].to_pylist():
        m = int(np.frombuffer(data, "<u4", 1)[0])
        name, size = np.frombuffer(data, np.int64, m, 4), np.frombuffer(data, np.uint32, m, 4 + 8 * m)
        count = np.frombuffer(data, np.uint32, m, 4 + 12 * m)
        low = np.frombuffer(data, np.uint8, offset=4 + 16 * m).reshape(-1, _SIG)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :_SIG] = low
        sids.append(np.repeat(name, count))
        sizes.append(np.repeat(size, count).astype(np.int64))
        sigs.append(wide.view("<u8").reshape(-1))
    sid, n, sig = np.concatenate(sids), np.concatenate(sizes), np.concatenate(sigs)
    order = np.argsort(sig, kind="stable")
    again = sig[order[1:]] == sig[order[:-1]]
    keep = np.zeros(len(sig), bool)
    keep[1:] |= again
    keep[:-1] |= again
    order = order[keep]  # most signatures are met once
    order = order[np.lexsort((sid[order], n[order], sig[order]))]
    sid, n, sig = sid[order], n[order], sig[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])  # one entry for each set: exact copies are one
    sid, n, sig = sid[fresh], n[fresh], sig[fresh]
    first = np.flatnonzero(np.diff(sig, prepend=sig[:1] + np.uint64(1)) != 0) if len(sig) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(sig))
    big = (last - first) > 1
    first, last = first[big], last[big]
    picked = ragged(np.arange(len(sig)), first, last - first)
    sid, n, tile = sid[picked], n[picked], np.repeat(np.arange(len(first)), last - first)
    starts = np.cumsum(last - first) - (last - first)
    pivot, left, right = np.zeros(len(sid), bool), [], []
    order = sid.view(np.uint64)
    for _ in range(2):
        order = mixed(order)
        own = order == np.minimum.reduceat(order, starts)[tile] if len(sid) else pivot
        with_pivot = sid[own][tile]
        left.append(np.minimum(sid, with_pivot)[~own])
        right.append(np.maximum(sid, with_pivot)[~own])
        pivot |= own
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0) if len(sid) else np.zeros((0, 2), np.int64)
    rest = ~pivot
    rest &= np.bincount(tile[rest], minlength=len(first))[tile] > 1 if len(sid) else rest
    name = (sig[first].astype(np.int64)[tile[rest]] << 20) ^ key[0].as_py()
    return pa.table({
        "open": np.concatenate([np.zeros(len(pairs), bool), np.ones(len(name), bool)]), "x": np.concatenate([pairs[:, 0], name]),
        "y": np.concatenate([pairs[:, 1], sid[rest]]), "n": np.concatenate([np.zeros(len(pairs), np.int64), n[rest]]),
    })


def _across(threshold: Fraction, bands: Bands):
    """Pairs across the components of open tiles that bit counts leave; a pair that several tiles here have comes once."""

    def run(key: tuple, rows: pa.Table, fine: pa.Table) -> pa.Table:
        rows = rows.sort_by([("tile", "ascending"), ("n", "ascending"), ("sid", "ascending")])
        tile, n, label, sid = (rows[c].to_numpy() for c in ("tile", "n", "label", "sid"))
        bits_of = dict(zip(fine["of_sid"].to_pylist(), fine["fine"].to_pylist()))
        limit = np.floor_divide(n * threshold.denominator, threshold.numerator)
        cuts = np.flatnonzero(np.diff(tile, prepend=tile[:1] - 1)).tolist() if len(tile) else []
        pairs = [np.zeros((0, 2), np.int64)]
        for a, b in zip(cuts, [*cuts[1:], len(tile)]):
            own, size, of = sid[a:b], n[a:b], label[a:b]
            width = bands.bits(int(bands.of(int(size[0]))), True)  # the smallest of them: all bitmaps fold to it
            bits = np.stack([folded(bits_of[x], width) for x in own.tolist()])
            last = np.searchsorted(size, limit[a:b], "right").tolist()
            for i in range(b - a):
                j = i + 1 + np.flatnonzero(of[i + 1 : last[i]] != of[i])
                if len(j):
                    j = j[linked(bound(bits[i], size[i], bits[j], size[j]), size[i], size[j], threshold)]
                    pairs.append(np.stack([np.minimum(own[i], own[j]), np.maximum(own[i], own[j])], 1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

    return run


def _passing(threshold: Fraction):
    """Pairs whose bit counts allow a link."""

    def run(batches):
        for batch in batches:
            a, b, n_a, n_b, bits_a, bits_b = (c.to_pylist() for c in batch.columns)
            keep = []
            for x, y, p, q in zip(n_a, n_b, bits_a, bits_b):
                width = 8 * min(len(p), len(q))
                keep.append(bool(linked(bound(folded(p, width), x, folded(q, width), y), x, y, threshold)))
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep) if k], pa.int64()) for c in (a, b)], ["a", "b"])

    return run


def _verified(threshold: Fraction, k: int):
    """Pairs whose sorted shingle arrays intersect enough."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for at in range(0, len(a), 64):
                names, texts = [], []
                for name, text in zip(a[at : at + 64] + b[at : at + 64], batch.column(2).slice(at, 64).to_pylist() + batch.column(3).slice(at, 64).to_pylist()):
                    if name not in kept and name not in names:
                        names.append(name)
                        texts.append(text)
                kept |= dict(zip(names, shingle_sets(pa.array(texts, pa.string()), k)))
                for x, y in zip(a[at : at + 64], b[at : at + 64]):
                    s, t = kept[x], kept[y]
                    out.append(bool(linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), threshold)))
                if sum(map(len, kept.values())) > 1 << 21:
                    kept.clear()
            keep = pa.array(out)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _id(column) -> Column:
    """A document's id, with a stand-in for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(-(1 << 63)))


def _check(pairs: DataFrame, sets: DataFrame, docs: DataFrame, threshold: Fraction, k: int, what: str) -> DataFrame:
    """The pairs of sets (a < b) that are linked: bit counts first, then texts."""
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    passing = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(lean(_passing(threshold)), "a bigint, b bigint")
    passing = settle(passing, f"{what}-passing")
    needed = passing.select(F.col("a").alias("sid")).union(passing.select(F.col("b").alias("sid"))).distinct()
    owners = needed.join(sets.select("sid", "row"), "sid").select("sid", "row.*")
    texts = settle(docs.join(owners, (_id(docs["doc_id"]) == owners["doc"]) & (docs["h"] == owners["h"])).select("sid", "text").dropDuplicates(["sid"]), f"{what}-texts")
    forget(docs.sparkSession)
    text = lambda c: texts.select(F.col("sid").alias(c), F.col("text").alias(f"text_{c}"))
    both = passing.join(text("b"), "b").join(text("a"), "a").select("a", "b", "text_a", "text_b")
    links = settle(both.mapInArrow(lean(_verified(threshold, k)), "a bigint, b bigint"), f"{what}-links")
    forget(docs.sparkSession)
    return links


def groups(docs: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """doc_id, h (xxhash64 of the text), n_shingles and component_id of each document (doc_id, text).

    Words are what ASCII white space separates, A-Z in lower case; a set is the distinct runs of k words, of fewer words
    the one run of all, without words or text empty and linked with nothing. Two documents link at a Jaccard similarity
    of at least ``threshold``; component_id is the smallest doc_id that links reach (the own one where there are none;
    null ids never name a group that has others). Equal sets are one set throughout, so copies and repeated rows cost
    nothing beyond the first, and rows of equal doc_id are documents of their own. Texts are read whole; an empty table
    gives an empty result; other columns are ignored. Shingles and sets go by 64-bit hashes.
    """
    spark = docs.sparkSession
    exact = Fraction(threshold).limit_denominator(1000)
    bands = Bands(exact)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    found = settle(_sets(docs, bands, k), "jaccard-sets")
    owner = F.min(F.struct(_id("doc_id").alias("doc"), "h")).alias("row")
    sets = found.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"), owner, F.max("n_shingles").alias("n"), F.max("bits").alias("bits"), F.max("fine").alias("fine"))
    sets = settle(sets, "jaccard-named")
    total = sets.agg(F.sum(F.when(F.col("n") > 4, F.col("n") + 4).otherwise(0))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(0.7 * total / ENTRIES))
    tiles = settle(_entries(docs, bands, k, parts).groupBy("part").applyInArrow(_tiles, "open boolean, x bigint, y bigint, n bigint"), "jaccard-tiles")
    forget(spark)
    first = settle(tiles.filter("NOT open").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "jaccard-stars")
    links = _check(first, sets, docs, exact, k, "jaccard-star")
    labels = components(links)
    members = tiles.filter("open").select(F.col("x").alias("tile"), F.col("y").alias("sid"), "n")
    labelled = members.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    open_tiles = labelled.groupBy("tile").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least != most").select("tile")
    left = settle(labelled.join(open_tiles, "tile"), "jaccard-open")
    left = left.withColumn("lot", F.pmod(F.xxhash64("tile"), F.lit(max(1, math.ceil(left.count() / MEMBERS)))))
    wanted = left.select(F.col("lot").alias("of_lot"), F.col("sid").alias("of_sid")).distinct()
    fine = wanted.join(sets.select(F.col("sid").alias("named"), "fine"), F.col("of_sid") == F.col("named")).select("of_lot", "of_sid", "fine")
    rest = left.groupBy("lot").cogroup(fine.groupBy("of_lot")).applyInArrow(_across(exact, bands), "a bigint, b bigint").distinct().join(first, ["a", "b"], "left_anti")
    more = _check(settle(rest, "jaccard-rest"), sets, docs, exact, k, "jaccard-across")
    final = components(links.unionByName(more))
    named = sets.select("sid", "least").join(final.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = settle(named.join(smallest, "label").select("sid", "component_id"), "jaccard-known")
    out = found.select("doc_id", "h", "n_shingles", "sid").join(known, "sid", "left")
    return out.select("doc_id", "h", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of ``groups``, that of the smallest doc_id (of rows that share it, that of the smallest text
    hash); rows without words all stay. The columns are those of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    some = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False)).alias("some")
    keyed = docs.select(row, _id(F.col("doc_id").cast("long")).alias("id"), F.xxhash64("text").alias("h"), some)
    found = groups(docs, **options).filter("n_shingles > 0").select(_id("doc_id").alias("id"), "h", _id("component_id").alias("component"))
    first = found.groupBy("component").agg(F.min(F.struct("id", "h")).alias("first")).select("first.id", "first.h")
    kept = keyed.filter("some").join(first, ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    whole = kept.select("row").unionByName(keyed.filter("NOT some").select("row"))
    return whole.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents."""
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2
), links AS MATERIALIZED (SELECT a, b FROM met WHERE 100 * common >= 80 * (na + nb - common)),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.least AS component_id
FROM sets s JOIN (SELECT node, min(seen) AS least FROM reach GROUP BY 1) r ON r.node = s.doc_id
"""
