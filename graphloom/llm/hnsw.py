"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, results merged."""

from __future__ import annotations

import functools
import io
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, read_whole, scratch, settle, table, write_whole


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, up to rounding."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0)


def _spread(vectors: np.ndarray, candidates: np.ndarray, distance: np.ndarray, keep: int, fill: bool) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) those nearer to the row's own vector than to any kept before,
    ``keep`` at most; with ``fill`` the nearest of the others take the places left."""
    rows, width = candidates.shape
    out = np.full((rows, keep), -1, np.int32)
    for at in range(0, rows, 256):
        c, d = candidates[at : at + 256], distance[at : at + 256]
        v = vectors[np.maximum(c, 0)]
        norm = np.einsum("rcd,rcd->rc", v, v)
        between = norm[:, :, None] + norm[:, None] - 2 * (v @ v.transpose(0, 2, 1))
        kept, n = np.zeros(c.shape, bool), np.zeros(len(c), np.int64)
        for j in range(width):
            clash = (kept & (between[:, j] < d[:, j, None])).any(1)
            take = (c[:, j] >= 0) & ~clash & (n < keep)
            kept[:, j] = take
            n += take
        if fill:
            for j in range(width):
                take = (c[:, j] >= 0) & ~kept[:, j] & (n < keep)
                kept[:, j] |= take
                n += take
        order = np.argsort(~kept, axis=1, kind="stable")[:, :keep]
        part = np.where(np.take_along_axis(kept, order, 1), np.take_along_axis(c, order, 1), -1)
        out[at : at + 256, : part.shape[1]] = part
    return out


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, squared distances) of about the ef rows nearest to each query that links reach from its entry; len(vectors)
    stands for none. All queries go side by side, each from its nearest open row."""
    n, q = len(vectors), len(queries)
    far = lambda rows, to: ((vectors[to] - queries[rows, None]) ** 2).sum(-1)
    ef = min(ef, n)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # the place of "none"
    seen[np.arange(q), entry] = True
    ids, dist, done = np.full((q, ef), n, np.int64), np.full((q, ef), np.inf, vectors.dtype), np.ones((q, ef), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = entry, far(np.arange(q), entry[:, None])[:, 0], False
    live = np.arange(q)
    while len(live):
        open_at = np.where(done[live], np.inf, dist[live])
        j = open_at.argmin(1)
        ok = np.isfinite(open_at[np.arange(len(live)), j])
        live, j = live[ok], j[ok]
        if not len(live):
            break
        done[live, j] = True
        to = links[ids[live, j]].astype(np.int64)
        to = np.where(to < 0, n, to)
        new = ~seen[live[:, None], to]
        seen[live[:, None], to] = True
        d = np.where(new, far(live, np.minimum(to, n - 1)), np.inf)
        all_d = np.concatenate([dist[live], d], 1)
        keep = np.argpartition(all_d, ef - 1, axis=1)[:, :ef]
        dist[live] = np.take_along_axis(all_d, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(new, to, n)], 1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), keep, 1)
    return ids, dist


def _down(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, start: int) -> np.ndarray:
    """Where single steps to the nearest neighbour lead each query, layer by layer. A layer: its rows in ascending order,
    and theirs neighbours."""
    here = np.full(len(queries), start, np.int64)
    far = lambda rows, to: ((vectors[to] - queries[rows, None]) ** 2).sum(-1)
    best = far(np.arange(len(queries)), here[:, None])[:, 0]
    for nodes, links in layers:
        live = np.arange(len(queries))
        while len(live):
            to = links[np.searchsorted(nodes, here[live])]
            d = np.where(to >= 0, far(live, np.maximum(to, 0)), np.inf)
            j = d.argmin(1)
            nearer = d[np.arange(len(live)), j] < best[live]
            live, j, to, d = live[nearer], j[nearer], to[nearer], d[nearer]
            here[live], best[live] = to[np.arange(len(live)), j], d[np.arange(len(live)), j]
    return here


def _linked_back(own: np.ndarray, links: np.ndarray, new: np.ndarray, first: int) -> None:
    """Links of new rows (from ``first`` on) also go back, and rows with too many keep spread-out ones."""
    source = np.repeat(np.arange(first, first + len(new)), new.shape[1])[new.reshape(-1) >= 0]
    target = new.reshape(-1)[new.reshape(-1) >= 0].astype(np.int64)
    touched = np.unique(target)
    old = links[touched]
    a = np.concatenate([np.repeat(touched, old.shape[1])[old.reshape(-1) >= 0], target])
    b = np.concatenate([old.reshape(-1)[old.reshape(-1) >= 0], source]).astype(np.int64)
    dist = ((own[a] - own[b]) ** 2).sum(1)
    order = np.lexsort((b, dist, a))
    a, b, dist = a[order], b[order], dist[order]
    place, row = np.arange(len(a)) - np.searchsorted(a, a, "left"), np.searchsorted(touched, a)
    c, d = np.full((len(touched), int(place.max(initial=0)) + 1), -1, np.int64), np.full((len(touched), int(place.max(initial=0)) + 1), np.inf, own.dtype)
    c[row, place], d[row, place] = b, dist
    links[touched] = _spread(own, c, d, links.shape[1], True)


def _layer(vectors: np.ndarray, members: np.ndarray, above: list[tuple[np.ndarray, np.ndarray]], m: int, most: int, width: int, batch: int = 512) -> np.ndarray:
    """Neighbour rows (len(members) x most) of one layer. Members come in lots, those of higher layers first: each is
    searched for in the graph of those before, entered by the layers above, and among the members of its lot before it;
    it links to spread-out ones among the nearest, and links go both ways."""
    n = len(members)
    own = vectors[members]
    links = np.full((n, most), -1, np.int32)
    place = np.full(len(vectors), -1, np.int64)
    place[members] = np.arange(n)
    for at in range(0, n, batch):
        stop = min(at + batch, n)
        d = _near(own[at:stop], own[at:stop])
        d[np.arange(stop - at)[None] >= np.arange(stop - at)[:, None]] = np.inf
        c = np.argsort(d, axis=1, kind="stable")[:, :width]
        d = np.take_along_axis(d, c, 1)
        c = c + at
        if at:
            top = above[0][0][0] if above else members[0]
            entry = place[_down(vectors, above, own[at:stop], int(top))]
            entry = np.where(entry < at, entry, 0)
            ids, dist = _beam(own[:at], links[:at], own[at:stop], entry, width)
            c, d = np.concatenate([c, ids], 1), np.concatenate([d, dist], 1)
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        new = _spread(own, np.where(np.isinf(d), -1, c), d, m, False)
        links[at:stop, :m] = new
        _linked_back(own, links, new, at)
    return np.where(links >= 0, members[np.maximum(links, 0)], -1).astype(np.int32)


def build(vectors: np.ndarray, m: int = 16, width: int = 64, seed: int = 1) -> dict:
    """A graph over the rows of ``vectors`` as flat arrays: layer l has nodes[l] and, row by row, links[l] (-1: none).
    Layers are built from the highest down, each by searches from the ones above."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    level = np.floor(-np.log(1 - rng.random(n)) / math.log(m)).astype(int)
    order = rng.permutation(n)
    order = order[np.argsort(-level[order], kind="stable")]
    layers: list[tuple[np.ndarray, np.ndarray]] = []
    for layer in range(int(level.max(initial=0)), -1, -1):
        members = order[level[order] >= layer]
        rows = _layer(vectors, members, layers, m, 2 * m if layer == 0 else m, width)
        back = np.argsort(members)
        layers.append((members[back].astype(np.int32), rows[back]))
    return {"nodes": [x for x, _ in layers[::-1]], "links": [x for _, x in layers[::-1]]}


def search(vectors: np.ndarray, graph: dict, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, squared distances) of about the k nearest rows of each query: down the layers by single steps, then a beam
    of ``ef`` in the lowest, for all queries side by side."""
    upper = list(zip(graph["nodes"], graph["links"]))[:0:-1]
    entry = _down(vectors, upper, queries, int(graph["nodes"][-1][0]))
    return _beam(vectors, graph["links"][0], queries, entry, max(ef, k))


def comparable(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a type in which squares of differences neither overflow nor vanish."""
    top = max((float(np.abs(x).max(initial=0)) for x in arrays), default=0.0)
    single = all(x.dtype == np.float32 for x in arrays) and 1e-12 < top < 1e15
    return [x.astype(np.float32 if single else np.float64 if 1e-140 < top < 1e140 else np.longdouble) for x in arrays]


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance in double precision, squares added from the first component to the last. Pairs whose squares
    would leave the range of doubles are scaled by a power of two, which changes no digit."""
    a, b = np.broadcast_arrays(a.astype(np.float64), b.astype(np.float64))
    _, power = np.frexp(np.maximum(np.abs(a).max(-1), np.abs(b).max(-1)))
    power = np.where(np.abs(power) > 400, power, 0)[..., None]
    d = np.ldexp(a, -power) - np.ldexp(b, -power)
    with np.errstate(over="ignore"):  # a distance beyond the largest double is infinite
        return np.ldexp(np.sqrt(np.cumsum(d * d, axis=-1)[..., -1]), power[..., 0])


def centres(x: np.ndarray, n: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """n centres of the rows of x, each the mean of the rows that are nearest to it."""
    c = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:n])]
    for _ in range(rounds if n > 1 else 0):
        near = _near(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.bincount(near, minlength=len(c))
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None].astype(x.dtype), c)
    return c


def _usable(rows: DataFrame, kind: str) -> DataFrame:
    """vec_id and the bytes of each vector that takes part; -0.0 becomes 0.0."""

    def run(batches):
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = v.values.to_numpy().astype(kind)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append((x + 0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return rows.mapInArrow(lean(run), "vec_id bigint, vec binary")


@functools.cache
def _opened(uri: str) -> tuple:
    """A shard's (vectors, first id of each, number of ids, ids, graph); a worker keeps the last one only."""
    if _opened.cache_info().currsize:
        _opened.cache_clear()
    with np.load(io.BytesIO(read_whole(uri))) as f:
        layers = range(int(f["layers"][0]))
        return f["vectors"], f["first"], f["count"], f["ids"], {"nodes": [f[f"nodes{i}"] for i in layers], "links": [f[f"links{i}"] for i in layers]}


def nearest(rows: DataFrame, queries, k: int = 10, shard_rows: int = 8192, m: int = 16, width: int = 64, ef: int = 160, block: int = 2048,
            max_cells: int = 4096, sample: int = 16_384, reach: float = 1.3) -> DataFrame:
    """The k nearest other rows of each row of ``rows`` (vec_id, embedding) that the condition ``queries`` selects.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without vec_id;
    only vectors of one length are held together. Equal vectors are one node that keeps its k + 1 smallest vec_ids (all
    that a result can name), gathered in two steps so that a vector with a third of all rows is no task's burden.
    Distinct vectors go to the nearest of at most ``max_cells`` centres, one for each ``shard_rows`` vectors, which are
    fitted to a sample of ``sample`` vectors of smallest hash; a cell is cut by hash into shards of about ``shard_rows``.
    Each shard's graph is a file of flat arrays in the shared folder, which the tasks that search it read. A query visits
    the cells whose centre is at most ``reach`` times as far as its nearest one: few where vectors lie in clusters, all
    where they do not. Shards' best are merged by score, then vec_id.

    Returns query_id, rank (from 1), vec_id and score (Euclidean distance, double). Equal rows ask once; rows of one
    vec_id with different vectors ask each, and none of them is a candidate of the others. Candidates of equal vec_id
    each count. An empty table gives an empty result. Other columns are ignored.
    """
    spark = rows.sparkSession
    element = rows.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    picked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    distinct = settle(_merged(_usable(picked, kind), k).withColumn("dim", F.length("vec")), "hnsw-vectors")
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fitted = {}
    for dim, n in sizes.items():
        cells = min(max_cells, math.ceil(n / shard_rows))
        wanted = sample if cells > 1 else 1
        # each task would send that many rows: below this hash lie about twice as many in all (and 64), whatever the tasks
        few = F.xxhash64("vec") <= min((1 << 63) - 1, (1 << 64) * (2 * wanted + 64) // n - (1 << 63))
        some = distinct.filter((F.col("dim") == dim) & few).orderBy(F.xxhash64("vec"), "vec").select("vec").limit(wanted).collect()
        (x,) = comparable(np.frombuffer(b"".join(bytes(r["vec"]) for r in some), kind).reshape(len(some), -1))
        fitted[dim] = centres(x, cells)

    def cells(reach: float | None):
        """The cells of each vector: the nearest, or all within reach."""

        def run(batches):
            for batch in batches:
                dims, vecs, found = batch.column("dim").to_pylist(), batch.column("vec").to_pylist(), [[]] * batch.num_rows
                for dim in set(dims):
                    at = [i for i, d in enumerate(dims) if d == dim and dim in fitted]
                    if at:
                        x, c = comparable(np.frombuffer(b"".join(vecs[i] for i in at), kind).reshape(len(at), -1), fitted[dim])
                        d = _near(x, c)
                        near = [[j] for j in d.argmin(1).tolist()] if reach is None else [np.flatnonzero(v <= v.min() * reach * reach).tolist() for v in d]
                        for i, own in zip(at, near):
                            found[i] = own
                yield batch.append_column("cells", pa.array(found, pa.list_(pa.int64())))

        return run

    placed = distinct.mapInArrow(lean(cells(None)), "vec binary, ids array<bigint>, dim int, cells array<bigint>").withColumn("cell", F.col("cells")[0]).drop("cells")
    placed = settle(placed, "hnsw-cells")
    found = {(r["dim"], r["cell"]): max(1, math.ceil(r["n"] / shard_rows)) for r in placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect()}
    folder = scratch(spark, "hnsw-graphs")
    uri = lambda dim, cell, shard: f"{folder}/{dim}-{cell}-{shard}.npz"

    def index(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("vec")
        x = np.frombuffer(b"".join(part["vec"].to_pylist()), kind).reshape(part.num_rows, -1)
        graph = build(comparable(x)[0], m, width)
        ids = part["ids"].to_pylist()
        count = np.asarray([len(i) for i in ids], np.int32)
        arrays = {"vectors": x, "first": np.cumsum(count) - count, "count": count, "ids": np.asarray([j for i in ids for j in i], np.int64), "layers": np.asarray([len(graph["nodes"])])}
        for i, (nodes, links) in enumerate(zip(graph["nodes"], graph["links"])):
            arrays |= {f"nodes{i}": nodes, f"links{i}": links}
        data = io.BytesIO()
        np.savez(data, **arrays)
        write_whole(uri(*(v.as_py() for v in key)), data.getbuffer())
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "cell": pa.array([key[1].as_py()], pa.int64()), "shard": pa.array([key[2].as_py()], pa.int64())})

    shards = spark.createDataFrame([(d, c, n) for (d, c), n in found.items()], "dim int, cell bigint, shards bigint")  # at most max_cells for each length
    graphs = placed.join(F.broadcast(shards), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")))
    graphs = settle(graphs.groupBy("dim", "cell", "shard").applyInArrow(index, "dim int, cell bigint, shard bigint"), "hnsw-index")
    asked = _usable(rows.filter(queries).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), kind).distinct().withColumn("dim", F.length("vec"))
    asked = asked.mapInArrow(lean(cells(reach)), "vec_id bigint, vec binary, dim int, cells array<bigint>")
    asked = settle(asked.select("vec_id", "vec", "dim", F.explode("cells").alias("cell")), "hnsw-queries")
    visits = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).alias("blocks"))
    tasks = asked.join(F.broadcast(visits), ["dim", "cell"]).join(graphs, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.col("blocks")))

    def find(key: tuple, right: pa.Table) -> pa.Table:
        own, first, count, ids, graph = _opened(uri(*(v.as_py() for v in key[:3])))
        q = np.frombuffer(b"".join(right["vec"].to_pylist()), kind).reshape(right.num_rows, -1)
        out = {"query_id": [], "vec": [], "score": [], "ids": []}
        names, vecs = right["vec_id"].to_pylist(), right["vec"].to_pylist()
        x, wanted = comparable(own, q)
        for at in range(0, len(q), 256):
            got, _ = search(x, graph, wanted[at : at + 256], k + 1, ef)
            there = np.minimum(got, len(own) - 1)
            score = np.where(got < len(own), exact_distance(q[at : at + 256, None], own[there]), np.inf)
            order = np.lexsort((ids[first[there]], score, got >= len(own)), axis=1)[:, : k + 1]
            for i in range(len(got)):
                for j in order[i]:
                    if (node := got[i, j]) < len(own):
                        out["query_id"].append(names[at + i])
                        out["vec"].append(vecs[at + i])
                        out["score"].append(float(score[i, j]))
                        out["ids"].append(ids[first[node] : first[node] + count[node]].tolist())
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec": pa.array(out["vec"], pa.binary()), "score": pa.array(out["score"], pa.float64()), "ids": pa.array(out["ids"], pa.list_(pa.int64()))})

    best = tasks.groupBy("dim", "cell", "shard", "block").applyInArrow(find, "query_id bigint, vec binary, score double, ids array<bigint>")
    each = best.select("query_id", "vec", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "vec").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _merged(usable: DataFrame, k: int) -> DataFrame:
    """vec and its k + 1 smallest vec_ids: of each batch, then of each of 64 parts, then of all."""

    def local(batches):
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(v, []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(i)[: k + 1] for i in held.values()], pa.list_(pa.int64()))], ["vec", "ids"])

    least = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, k + 1).alias("ids")
    parts = usable.mapInArrow(lean(local), "vec binary, ids array<bigint>")
    return parts.groupBy("vec", F.pmod(F.col("ids")[0], F.lit(64)).alias("part")).agg(least("ids")).groupBy("vec").agg(least("ids"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, q.e AS asked, v.vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0) AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id, asked ORDER BY score, vec_id) AS rank FROM d
) WHERE rank <= 10
"""
