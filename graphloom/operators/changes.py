"""Changes: each takes a graph and returns a new one; nothing is written in place."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import numbered, settle
from ..errors import NotAVariant, NotFound, UnknownProperty, WrongType, raised
from ..schema import Prop, Schema, edge_errors, node_errors, property_text
from .graph import Graph

def _refuse(bad: DataFrame) -> None:
    first = bad.select("errors").limit(1).collect()
    if first:
        raise raised(first[0]["errors"])


def _last(rows: DataFrame) -> int:
    return rows.agg(F.max("id")).first()[0] or 0


def new_nodes(g: Graph, rows: DataFrame) -> DataFrame:
    """Rows (kind, properties) as nodes with new ids; any that the schema does not allow refuses all."""
    checked = rows.select("kind", F.coalesce("properties", F.lit("{}")).alias("properties")).withColumn("errors", node_errors(g.schema))
    _refuse(checked.filter(F.size("errors") > 0))
    now = F.localtimestamp()
    return numbered(checked.drop("errors"), _last(g.nodes), "kind", "properties").select("id", "kind", "properties", now.alias("created_at"), now.alias("updated_at"))


def add_nodes(g: Graph, rows: DataFrame) -> Graph:
    """The graph with ``new_nodes``."""
    return g.of(nodes=g.nodes.unionByName(new_nodes(g, rows)))


def _edited(changes: dict[str, object]) -> Column:
    """The properties as JSON with sorted keys, some of them replaced; None takes a key out. All other keys and values
    stay what they are, whether the schema has them or not; malformed properties count as none."""
    old = F.coalesce(F.from_json("properties", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    new = {k: v for k, v in changes.items() if v is not None}
    kept = F.map_filter(old, lambda k, _: ~k.isin(list(changes))) if changes else old
    if new:
        kept = F.map_concat(kept, F.create_map(*[c for k, v in sorted(new.items()) for c in (F.lit(k), F.parse_json(F.lit(json.dumps(v))))]))

    def ordered(m: Column) -> Column:
        keys = F.sort_array(F.map_keys(m))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: m[k]))

    return F.to_json(F.get(F.transform(F.array(kept), ordered), F.lit(0)))


def _known(changes: dict[str, object], props: dict[str, Prop], where: str) -> None:
    for name in sorted(changes):
        if name not in props:
            raise UnknownProperty(f"unknown property: {name} of {where}")
        value, prop = changes[name], props[name]
        if value is None:
            continue
        whole = isinstance(value, int) and not isinstance(value, bool)
        fits = {"int": whole and -(1 << 63) <= value < 1 << 63, "float": whole or isinstance(value, float), "bool": isinstance(value, bool)}.get(prop.type, isinstance(value, str))
        if not fits:
            raise WrongType(f"{name}: {value!r} is not {prop}")
        if prop.type == "enum" and value not in prop.variants:
            raise NotAVariant(f"{name}: {value!r} is not {prop}")


def set_node(g: Graph, kind: str, node_id: int, changes: dict[str, object]) -> Graph:
    """Merge properties into a node; None removes one."""
    _known(changes, g.schema.node(kind), kind)
    g.require(kind, node_id)
    return g.of(nodes=set_where(g.nodes, (F.col("id") == node_id) & (F.col("kind") == kind), changes))


def set_where(nodes: DataFrame, where: Column, changes: dict[str, object]) -> DataFrame:
    """The bulk form: the same change on all rows that ``where`` selects."""
    hit = F.coalesce(where, F.lit(False))
    out = nodes.withColumn("properties", F.when(hit, _edited(changes)).otherwise(F.col("properties")))
    return out.withColumn("updated_at", F.when(hit, F.localtimestamp()).otherwise(F.col("updated_at"))) if "updated_at" in nodes.columns else out


def rekind(g: Graph, kind: str, node_id: int, to: str) -> Graph:
    """Make a node another kind: its properties must be valid there; its edges' end kinds follow, unchecked."""
    g.schema.node(to)
    g.require(kind, node_id)
    moved = g.resolve(kind, node_id).withColumn("kind", F.lit(to)).withColumn("errors", node_errors(g.schema))
    _refuse(moved.filter(F.size("errors") > 0))
    hit = F.col("id") == node_id
    ends = {f"{side}_kind": F.when(F.col(f"{side}_id") == node_id, F.lit(to)).otherwise(F.col(f"{side}_kind")) for side in ("from", "to")}
    nodes = g.nodes.withColumns({"updated_at": F.when(hit, F.localtimestamp()).otherwise(F.col("updated_at")), "kind": F.when(hit, F.lit(to)).otherwise(F.col("kind"))})
    return g.of(nodes=nodes, edges=g.edges.withColumns(ends))


def remove_nodes(g: Graph, ids: DataFrame) -> Graph:
    """Without these nodes (id) and the edges at them."""
    gone = ids.select("id").distinct()
    ends = lambda c: g.edges[c] == gone["id"]
    edges = g.edges.join(gone, ends("from_id"), "left_anti")
    edges = edges.join(ids.select(F.col("id").alias("gone")).distinct(), F.col("to_id") == F.col("gone"), "left_anti")
    return g.of(nodes=g.nodes.join(gone, "id", "left_anti"), edges=edges)


def remove_node(g: Graph, kind: str, node_id: int) -> Graph:
    g.require(kind, node_id)
    at = (F.col("from_id") == node_id) | (F.col("to_id") == node_id)
    return g.of(nodes=g.nodes.filter(F.col("id") != node_id), edges=g.edges.filter(~at))


def new_edges(g: Graph, rows: DataFrame) -> DataFrame:
    """Rows (kind, from_id, to_id, properties) as edges with new ids; ends must be there and fit. Equal edges may stand
    side by side."""
    asked = rows.select("kind", "from_id", "to_id", F.coalesce("properties", F.lit("{}")).alias("properties"))
    a = g.nodes.select(F.col("id").alias("from_id"), F.col("kind").alias("from_kind"))
    b = g.nodes.select(F.col("id").alias("to_id"), F.col("kind").alias("to_kind"))
    ended = settle(asked.join(a, "from_id", "left").join(b, "to_id", "left"), "linked")
    if lost := ended.filter("from_kind IS NULL OR to_kind IS NULL").limit(1).collect():
        raise NotFound(f"no node {lost[0]['from_id'] if lost[0]['from_kind'] is None else lost[0]['to_id']}")
    checked = ended.withColumn("errors", edge_errors(g.schema))
    _refuse(checked.filter(F.size("errors") > 0))
    new = numbered(checked.drop("errors"), _last(g.edges), "kind", "from_id", "to_id", "properties").withColumn("created_at", F.localtimestamp())
    return new.select(*g.edges.columns)


def link(g: Graph, rows: DataFrame) -> Graph:
    """The graph with ``new_edges``."""
    return g.of(edges=g.edges.unionByName(new_edges(g, rows)))


def set_edge(g: Graph, from_id: int, kind: str, to_id: int, changes: dict[str, object]) -> Graph:
    """Merge properties into all edges of a triple, starting from the first one's."""
    _known(changes, g.schema.edge(kind).props, kind)
    first = g.edge(from_id, kind, to_id).select(_edited(changes).alias("p")).collect()
    if not first:
        raise NotFound(f"no edge {from_id} {kind} {to_id}")
    hit = (F.col("from_id") == from_id) & (F.col("kind") == kind) & (F.col("to_id") == to_id)
    return g.of(edges=g.edges.withColumn("properties", F.when(hit, F.lit(first[0]["p"])).otherwise(F.col("properties"))))


def unlink(g: Graph, from_id: int, kind: str, to_id: int) -> Graph:
    """Without all edges of a triple."""
    hit = (F.col("from_id") == from_id) & (F.col("kind") == kind) & (F.col("to_id") == to_id)
    if not g.edges.filter(hit).limit(1).count():
        raise NotFound(f"no edge {from_id} {kind} {to_id}")
    return g.of(edges=g.edges.filter(~hit))


def natural_key(schema: Schema) -> Column:
    """The declared key properties of a kind as one text; all properties where none are declared or all are null."""
    out = F.lit(None).cast("string")
    for kind, keys in schema.natural_keys.items():
        own = F.concat_ws("\u0001", *[F.coalesce(property_text(k), F.lit("\u0000")) for k in keys])
        some = F.coalesce(*[property_text(k) for k in keys])
        out = F.when((F.col("kind") == kind) & some.isNotNull(), own).otherwise(out)
    return F.coalesce(out, F.col("properties"))


def _keyed(g: Graph, schema: Schema, name: str) -> DataFrame:
    return g.nodes.select(F.col("id").alias(name), "kind", natural_key(schema).alias("nk"))


def id_map(local: Graph, remote: Graph, id_first: bool = False) -> DataFrame:
    """remote_id, local_id of the remote nodes that are here already: by kind and natural key (the smallest local id);
    with ``id_first`` by equal id and kind before that."""
    here = _keyed(local, local.schema, "local_id").groupBy("kind", "nk").agg(F.min("local_id").alias("local_id"))
    by_key = _keyed(remote, local.schema, "remote_id").join(here, ["kind", "nk"]).select("remote_id", "local_id")
    return _id_first(local, remote, by_key) if id_first else by_key


def _id_first(local: Graph, remote: Graph, by_key: DataFrame) -> DataFrame:
    own = local.nodes.select(F.col("id").alias("local_id"), F.col("kind").alias("local_kind"))
    there = remote.nodes.select(F.col("id").alias("remote_id"), "kind")
    equal = there.join(own, (F.col("remote_id") == F.col("local_id")) & (F.col("kind") == F.col("local_kind"))).select("remote_id", "local_id")
    return equal.unionByName(by_key.join(equal.select("remote_id"), "remote_id", "left_anti"))


def merge_parts(local: Graph, remote: Graph, id_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that ``merge`` adds.

    Natural keys of both sides are computed once and written: what is new, its numbers and the map of ids all come from
    those narrow tables. With ``id_first`` only nodes that were local before match by id, never those just numbered.
    """
    here = settle(_keyed(local, local.schema, "local_id"), "merge-local")
    there = settle(remote.nodes.withColumn("nk", natural_key(local.schema)), "merge-remote")
    fresh = there.join(here.select("kind", "nk").distinct(), ["kind", "nk"], "left_anti")
    fresh = fresh.groupBy("kind", "nk").agg(F.min_by("properties", "id").alias("properties"), F.min("created_at").alias("created_at"), F.min("updated_at").alias("updated_at"))
    last = here.agg(F.max("local_id")).first()[0] or 0
    new = settle(numbered(fresh, last, "kind", "nk"), "merge-nodes")
    known = here.unionByName(new.select(F.col("id").alias("local_id"), "kind", "nk")).groupBy("kind", "nk").agg(F.min("local_id").alias("local_id"))
    by_key = there.select(F.col("id").alias("remote_id"), "kind", "nk").join(known, ["kind", "nk"]).select("remote_id", "local_id")
    ids = settle(_id_first(local, remote, by_key) if id_first else by_key, "merge-ids")
    a, b = (ids.select(F.col("remote_id").alias(f"{s}_id"), F.col("local_id").alias(f"new_{s}")) for s in ("from", "to"))
    mapped = remote.edges.join(a, "from_id").join(b, "to_id").drop("id", "from_id", "to_id").withColumnsRenamed({"new_from": "from_id", "new_to": "to_id"})
    edges = mapped.join(local.edges.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti").dropDuplicates(["from_id", "to_id", "kind", "properties"])
    edges = numbered(edges, _last(local.edges), "kind", "from_id", "to_id", "properties")
    return new.select(*local.nodes.columns), edges.select(*local.edges.columns)


def merge(local: Graph, remote: Graph, id_first: bool = False) -> Graph:
    """The local graph with what the remote one has besides: nodes by natural key (one of each key), then edges between
    mapped nodes that no local edge equals in ends and kind. ``id_first``: a remote node that has the id and kind of one
    that was local before is that node, whatever its properties (so unrelated graphs should not be merged that way)."""
    nodes, edges = merge_parts(local, remote, id_first)
    return local.of(nodes=local.nodes.unionByName(nodes), edges=local.edges.unionByName(edges))
