"""Graphs as Parquet: folders of typed nodes and of edges in both orders, and numbered snapshots made of them."""

from __future__ import annotations

import functools
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import hadoop, settle
from ..errors import Conflict, NotFound, StorageError
from ..operators.graph import EDGE, NODE, Graph, columned
from ..schema import SPARK_TYPES, Schema, typed

#: Seconds to wait before a change is tried again.
WAITS = (0.05, 0.1, 0.2)
#: Folders of nodes, or of edges, from which a snapshot is written whole again.
FOLDERS = 16


def _names(shape: str) -> list[str]:
    return [f.split()[0] for f in shape.split(", ")]


def _typed_shape(schema: Schema) -> str:
    """A struct for each kind with columns of its own, all of which are null but that of the row's kind."""
    kinds = [f"`{k}`: struct<{', '.join(f'`{p}`: {SPARK_TYPES[d.type]}' for p, d in columned(ps).items())}>" for k, ps in schema.nodes.items() if columned(ps)]
    return f"struct<{', '.join(kinds)}>"


def _write_nodes(nodes: DataFrame, schema: Schema, path: str) -> dict[str, list[int]]:
    """Nodes by kind, by id within, with their properties as JSON and, beside it, as typed columns: a filter on a
    declared property reads the row groups that can hold it. Returns the smallest and largest id of each kind."""
    own = [F.when(F.col("kind") == k, F.struct(*[typed(p, d).alias(p) for p, d in columned(ps).items()])).alias(k) for k, ps in schema.nodes.items() if columned(ps)]
    rows = nodes.select(*_names(NODE), *([F.struct(*own).alias("typed")] if own else []))
    rows.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id").write.partitionBy("kind").parquet(path)
    back = nodes.sparkSession.read.schema(NODE).parquet(path)
    return {r["kind"]: [r["least"], r["most"]] for r in back.groupBy("kind").agg(F.min("id").alias("least"), F.max("id").alias("most")).collect()}


def _write_edges(edges: DataFrame, path: str) -> None:
    """Edges by kind twice: by their start under ``out``, by their end under ``in``."""
    settled = settle(edges, "edges")
    for order, side in (("out", "from_id"), ("in", "to_id")):
        settled.repartitionByRange("kind", side).sortWithinPartitions("kind", side).write.partitionBy("kind").parquet(f"{path}/{order}")


def _read(spark: SparkSession, shape: str, folders: list[str]) -> DataFrame:
    parts = [spark.read.schema(shape).parquet(f) for f in folders]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], shape)


def open_folders(spark: SparkSession, schema: Schema, nodes: list[dict], edges: list[str]) -> Graph:
    """The graph that folders hold together. A filter on kind reads only its folders."""
    shape = f"{NODE}, typed {_typed_shape(schema)}"
    all_nodes = _read(spark, shape, [n["path"] for n in nodes])
    tables, spans = {}, {}
    for kind, props in schema.nodes.items():
        own = [F.col(f"typed.{kind}.{p}").alias(p) for p in columned(props)]
        held = _read(spark, shape, [n["path"] for n in nodes if kind in n["spans"]]) if nodes else all_nodes
        tables[kind] = held.filter(F.col("kind") == kind).select("id", *own, "properties", "created_at", "updated_at")
    for n in nodes:
        for kind, (least, most) in n["spans"].items():
            a, b = spans.get(kind, (least, most))
            spans[kind] = (min(a, least), max(b, most))
    out, into = (_read(spark, EDGE, [f"{e}/{side}" for e in edges]).select(*_names(EDGE)) for side in ("out", "in"))
    return Graph(schema, all_nodes.select(*_names(NODE)), out, tables, spans, into)


def export(g: Graph, prefix: str) -> str:
    """Write a whole graph under ``prefix`` and return its folder. Folders are never overwritten."""
    path = f"{prefix.rstrip('/')}/{uuid.uuid4().hex}"
    spans = _write_nodes(g.nodes, g.schema, f"{path}/nodes")
    _write_edges(g.edges, f"{path}/edges")
    _put(g.spark, f"{path}/graph.json", {"nodes": [{"path": f"{path}/nodes", "spans": spans}], "edges": [f"{path}/edges"]})
    return path


def load(spark: SparkSession, path: str, schema: Schema) -> Graph:
    """What ``export`` wrote."""
    found = _get(spark, f"{path.rstrip('/')}/graph.json")
    if found is None:
        raise NotFound(f"no graph in {path}")
    return open_folders(spark, schema, found["nodes"], found["edges"])


def _put(spark: SparkSession, uri: str, value: dict) -> bool:
    """Write a small file that is not there yet; False if it is."""
    fs, path = hadoop(spark, uri)
    try:
        out = fs.create(path, False)
    except Exception as e:
        if fs.exists(path):
            return False
        raise StorageError(f"{uri}: {e}") from e
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    return True


def _get(spark: SparkSession, uri: str) -> dict | None:
    """A small file; None if it is not there or was never finished."""
    fs, path = hadoop(spark, uri)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


@dataclass(frozen=True)
class Store:
    """A graph in a folder, as snapshots 1, 2, 3 ...: each is a small file that lists folders of nodes and of edges.

    A change that only adds writes only what it adds, and lists it beside the folders of the snapshot before; other
    changes write the table that they change. From ``FOLDERS`` folders on, the next change writes all. Of two writers
    that start from one snapshot, one creates the next number, and the other reads that snapshot and tries again."""

    spark: SparkSession
    prefix: str
    schema: Schema

    def _mark(self, number: int) -> str:
        return f"{self.prefix.rstrip('/')}/_current/{number}.json"

    def latest(self) -> tuple[int, dict]:
        """The number and lists of the current snapshot; 0 and nothing if there is none."""
        fs, where = hadoop(self.spark, f"{self.prefix.rstrip('/')}/_current")
        numbers = sorted((int(n) for s in fs.listStatus(where) if (n := s.getPath().getName().partition(".")[0]).isdecimal()), reverse=True) if fs.exists(where) else []
        for number in numbers:
            if (found := _get(self.spark, self._mark(number))) is not None:
                return max(numbers), found
        return max(numbers, default=0), {"nodes": [], "edges": []}

    def load(self) -> Graph:
        found = self.latest()[1]
        return open_folders(self.spark, self.schema, found["nodes"], found["edges"])

    def size(self) -> int:
        """Bytes of the current snapshot's folders."""
        found, total = self.latest()[1], 0
        for folder in (*[n["path"] for n in found["nodes"]], *found["edges"]):
            fs, path = hadoop(self.spark, folder)
            total += fs.getContentSummary(path).getLength()
        return total

    def change(self, make: Callable[[Graph], Graph | tuple[DataFrame | None, DataFrame | None]]) -> Graph:
        """Apply a change to the current graph and make its result the next snapshot. ``make`` returns a graph, or the
        nodes and edges to add. Raises Conflict if other writers are first each time."""
        for wait in (*WAITS, None):
            number, found = self.latest()
            before = open_folders(self.spark, self.schema, found["nodes"], found["edges"])
            made = make(before)
            path = f"{self.prefix.rstrip('/')}/{uuid.uuid4().hex}"
            if isinstance(made, Graph):
                nodes = made.nodes if made.nodes is not before.nodes else None
                edges = made.edges if made.edges is not before.edges else None
                whole = True
            else:
                (nodes, edges), whole = made, False
                if nodes is None and edges is None:
                    return before
                if max(len(found["nodes"]), len(found["edges"])) >= FOLDERS:
                    add = lambda a, b: a if b is None else a.unionByName(b)
                    nodes, edges, whole = add(before.nodes, nodes), add(before.edges, edges), True
            after = dict(found)
            if nodes is not None:
                after["nodes"] = [*([] if whole else found["nodes"]), {"path": f"{path}/nodes", "spans": _write_nodes(nodes, self.schema, f"{path}/nodes")}]
            if edges is not None:
                _write_edges(edges, f"{path}/edges")
                after["edges"] = [*([] if whole else found["edges"]), f"{path}/edges"]
            if _put(self.spark, self._mark(number + 1), after):
                return open_folders(self.spark, self.schema, after["nodes"], after["edges"])
            if wait is not None:
                time.sleep(wait)
        raise Conflict(f"{self.prefix}: changed by others {len(WAITS) + 1} times")


_JSON = {"nodes": NODE, "edges": EDGE}


def export_json(g: Graph, path: str) -> str:
    """Write a graph as lines of JSON under ``path``/nodes and ``path``/edges, properties as objects (malformed ones as
    empty)."""
    for name, rows in (("nodes", g.nodes), ("edges", g.edges)):
        document = F.coalesce(F.try_parse_json("properties"), F.parse_json(F.lit("{}")))
        rows.withColumn("properties", document).select(F.to_json(F.struct(*_names(_JSON[name]))).alias("value")).write.text(f"{path.rstrip('/')}/{name}")
    return path


def import_json(spark: SparkSession, path: str, schema: Schema) -> Graph:
    """What ``export_json`` wrote."""
    parts = []
    for name, shape in _JSON.items():
        lines = spark.read.text(f"{path.rstrip('/')}/{name}")
        rows = lines.select(F.from_json("value", shape.replace("properties string", "properties variant")).alias("r")).select("r.*")
        parts.append(rows.withColumn("properties", F.to_json("properties")).select(*_names(shape)))
    return Graph(schema, *parts)
