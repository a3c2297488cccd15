"""The graph: nodes and edges as DataFrames, and everything that reads them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import numbered, settle
from ..errors import NotFound, UnknownProperty, ValidationError
from ..filters import conjunction
from ..functions.text import jaro_winkler, label, may_have_stem, ref, stems, terms, words
from ..schema import Prop, Schema, ident, property_text, typed

NODE = "id bigint, kind string, properties string, created_at timestamp_ntz, updated_at timestamp_ntz"
EDGE = "id bigint, kind string, from_id bigint, to_id bigint, from_kind string, to_kind string, properties string, created_at timestamp_ntz"
DEEPEST = 5
_TAKEN = ("id", "kind", "properties", "created_at", "updated_at")


def parse_path(text: str) -> list[tuple[str | None, bool]]:
    """KIND/~KIND/* as (kind or None for any, reversed) for each hop."""
    steps = [s.strip() for s in text.split("/")]
    names = [s.removeprefix("~") for s in steps]
    if not all(names):
        raise ValidationError(f"no edge path: {text!r}")
    return [(None if name == "*" else ident(name), s.startswith("~")) for name, s in zip(names, steps)]


def columned(props: dict[str, Prop]) -> dict[str, Prop]:
    """The properties that can be columns beside a node's own: Spark does not tell names apart by case."""
    names = [p.lower() for p in props]
    return {k: p for k, p in props.items() if k.lower() not in _TAKEN and names.count(k.lower()) == 1}


@dataclass(frozen=True)
class Graph:
    """Nodes and edges, with properties as JSON text. What storage knows besides is used where it is given, and left
    behind by changes: ``tables``, nodes of a kind with typed property columns, so that filters reach the files;
    ``spans``, the smallest and largest id of each kind; ``inbound``, the edges ordered by their end."""

    schema: Schema
    nodes: DataFrame
    edges: DataFrame
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    spans: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    inbound: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession, schema: Schema) -> Graph:
        return cls(schema, spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def of(self, **parts) -> Graph:
        if "nodes" in parts:
            parts = {"tables": {}, "spans": {}} | parts
        if "edges" in parts:
            parts = {"inbound": None} | parts
        return replace(self, **parts)

    # -- scans -----------------------------------------------------------------------------------------------------

    def table(self, kind: str) -> DataFrame:
        """All nodes of a kind: id, ``columned`` properties by type, properties, created_at, updated_at."""
        props = columned(self.schema.node(kind))
        if kind in self.tables:
            return self.tables[kind]
        return self.nodes.filter(F.col("kind") == kind).select("id", *[typed(k, p).alias(k) for k, p in props.items()], "properties", "created_at", "updated_at")

    def typed(self, kind: str, register: bool = False) -> DataFrame:
        """All nodes of a kind with typed property columns; ``register``: also as view v_<kind>."""
        props = self.schema.node(kind)
        out = self.table(kind).select("id", *[F.col(k) if k in columned(props) else typed(k, p).alias(k) for k, p in props.items()], "created_at", "updated_at")
        if register:
            out.createOrReplaceTempView(f"v_{kind.lower()}")
        return out

    def _selected(self, kind: str, filters: tuple[str, ...]) -> DataFrame:
        props = self.schema.node(kind)
        return self.table(kind).filter(conjunction(filters, props, columned(props)))

    def by_id(self, node_id: int) -> DataFrame:
        found = self.nodes.filter(F.col("id") == node_id)
        return found.filter(F.col("kind").isin([k for k, (a, b) in self.spans.items() if a <= node_id <= b])) if self.spans else found

    def resolve(self, kind: str, node_id: int) -> DataFrame:
        return self.by_id(node_id).filter(F.col("kind") == kind)

    def require(self, kind: str, node_id: int) -> None:
        if not self.resolve(kind, node_id).limit(1).count():
            raise NotFound(f"no node {kind}:{node_id}")

    def edge(self, from_id: int, kind: str, to_id: int) -> DataFrame:
        """The first edge of this triple."""
        return self._triple(from_id, kind, to_id).orderBy("id").limit(1)

    def _triple(self, from_id: int, kind: str, to_id: int) -> DataFrame:
        return self.edges.filter((F.col("from_id") == from_id) & (F.col("kind") == kind) & (F.col("to_id") == to_id))

    def incident(self, node_id: int, outgoing: bool = True, incoming: bool = True, kind: str | None = None) -> DataFrame:
        """Edges at a node with their direction; a loop is outgoing. Neither flag is as both."""
        both = outgoing == incoming
        out = self.edges.filter(F.col("from_id") == node_id).withColumn("direction", F.lit("out"))
        into = (self.edges if self.inbound is None else self.inbound).filter((F.col("to_id") == node_id) & (F.col("from_id") != node_id)).withColumn("direction", F.lit("in"))
        found = out.unionByName(into) if both else out if outgoing else into
        return found if kind is None else found.filter(F.col("kind") == kind)

    def grouped(self, node_id: int, **which) -> DataFrame:
        """Other ends by direction and edge kind."""
        other = F.when(F.col("direction") == "out", F.concat_ws(":", "to_kind", "to_id")).otherwise(F.concat_ws(":", "from_kind", "from_id"))
        return self.incident(node_id, **which).groupBy("direction", "kind").agg(F.array_join(F.sort_array(F.collect_list(other)), ",").alias("others"))

    def full(self, kind: str, node_id: int) -> DataFrame:
        """A node's label beside its grouped edges; one row without direction if it has none."""
        node = self.resolve(kind, node_id).select(ref().alias("ref"), label().alias("label"))
        return node.join(self.grouped(node_id), F.lit(True), "left")

    # -- find, count -----------------------------------------------------------------------------------------------

    def find(self, kind: str, *filters: str, order: str | None = None, limit: int | None = 30) -> DataFrame:
        """Nodes of a kind that all filters select. order: property[:direction], on text, descending where the direction is
        lacking or desc in any case, else ascending; without order the newest id first."""
        found = self._selected(kind, filters).select("id", F.lit(kind).alias("kind"), "properties", "created_at", "updated_at")
        keys = [F.col("id").desc()]
        if order:
            name, _, direction = order.partition(":")
            text = property_text(name)
            keys = [text.desc_nulls_last() if (direction or "desc").lower() == "desc" else text.asc_nulls_last(), F.col("id").asc()]
        return found.orderBy(*keys) if limit is None else found.orderBy(*keys).limit(limit)

    def count(self, kind: str, *filters: str, by: str | None = None) -> DataFrame:
        """How many nodes of a kind, all or by a property (null is a group)."""
        if by is None:
            found = self._selected(kind, filters) if kind in self.schema.nodes else self.nodes.filter(F.col("kind") == kind).filter(conjunction(filters, {}))
            return found.agg(F.count("*").alias("n"))
        props = self.schema.node(kind)
        if by not in props:
            raise UnknownProperty(f"{kind} has no property {by}")
        value = F.col(by) if by in columned(props) else typed(by, props[by])
        return self._selected(kind, filters).groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))

    def kinds(self) -> DataFrame:
        return self.nodes.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")

    def edge_kinds(self) -> DataFrame:
        return self.edges.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")

    def stats(self) -> DataFrame:
        """Counts of nodes by kind and of edges by kind, with totals (kind null)."""
        own = lambda df, what: df.rollup("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
        return own(self.nodes, "node").unionByName(own(self.edges, "edge"))

    # -- walk ------------------------------------------------------------------------------------------------------

    def walk_from(self, starts: DataFrame, path: str) -> DataFrame:
        """(start_id, id) of the nodes that each start (start_id) reaches along the path. Frontiers are made distinct at
        each hop, so parallel edges and hubs never multiply; nodes are joined once, at the end."""
        here = starts.select("start_id", F.col("start_id").alias("at")).distinct()
        for kind, back in parse_path(path):
            if kind is not None:
                self.schema.edge(kind)
            steps = self.inbound if back and self.inbound is not None else self.edges
            steps = steps if kind is None else steps.filter(F.col("kind") == kind)
            near, far = ("to_id", "from_id") if back else ("from_id", "to_id")
            steps = steps.select(F.col(near).alias("at"), F.col(far).alias("next"))
            here = here.join(steps, "at").select("start_id", F.col("next").alias("at")).distinct()
        return here.withColumnRenamed("at", "id")

    def walk(self, start: int, path: str, *where: str, limit: int | None = 30) -> DataFrame:
        """The nodes at the end of the path, by id; ``where`` filters them. A start that is not there reaches none."""
        starts = self.spark.createDataFrame([(start,)], "start_id bigint")
        found = self.nodes.join(self.walk_from(starts, path).select("id"), "id", "left_semi")
        found = found.filter(conjunction(where, {})) if where else found
        found = found.orderBy("id")
        return found if limit is None else found.limit(limit)

    # -- paths -----------------------------------------------------------------------------------------------------

    def adjacent(self, via: list[str] | None = None) -> DataFrame:
        """Every edge from both of its ends (a loop once): an equality join instead of one on either end."""
        edges = self.edges if via is None else self.edges.filter(F.col("kind").isin([ident(v) for v in via]))
        ahead = edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("next"), F.col("kind").alias("edge_kind"), F.lit(">").alias("direction"), F.col("id").alias("edge_id"))
        back = edges.filter("from_id != to_id").select(F.col("to_id").alias("at"), F.col("from_id").alias("next"), F.col("kind").alias("edge_kind"), F.lit("<").alias("direction"), F.col("id").alias("edge_id"))
        return ahead.unionByName(back)

    def paths(self, pairs: DataFrame, depth: int = 3, via: list[str] | None = None) -> DataFrame:
        """start_id, target_id, n_hops and hops (edge_kind, direction, node) of a shortest path for each pair, breadth
        first over all pairs at once. Each level keeps one way to a node, the smallest; pairs that are done leave. Levels
        are written to the shared folder. No row for a pair that ``depth`` (5 at most) does not connect."""
        hop = "array<struct<edge_kind:string,direction:string,edge_id:bigint,node:bigint>>"
        open_pairs = pairs.select("start_id", "target_id").distinct()
        open_pairs = open_pairs.join(self.nodes.select(F.col("id").alias("start_id")), "start_id", "left_semi")
        front = open_pairs.select("start_id", "target_id", F.col("start_id").alias("at"), F.array().cast(hop).alias("hops"))
        front = settle(front, "path-0")
        seen = front.select("start_id", "target_id", "at")
        done = [front.filter("at = target_id")]
        steps = self.adjacent(via)
        for level in range(1, min(depth, DEEPEST) + 1):
            front = front.join(front.filter("at = target_id").select("start_id", "target_id").distinct(), ["start_id", "target_id"], "left_anti")
            far = front.join(steps, "at").select("start_id", "target_id", F.col("next").alias("at"), F.concat("hops", F.array(F.struct("edge_kind", "direction", "edge_id", F.col("next").alias("node")))).alias("hops"))
            far = far.join(seen, ["start_id", "target_id", "at"], "left_anti").groupBy("start_id", "target_id", "at").agg(F.min("hops").alias("hops"))
            front = settle(far, f"path-{level}")
            if not front.limit(1).count():
                break
            seen = seen.unionByName(front.select("start_id", "target_id", "at"))
            done.append(front.filter("at = target_id"))
            if not front.select("start_id", "target_id").distinct().join(front.filter("at = target_id").select("start_id", "target_id").distinct(), ["start_id", "target_id"], "left_anti").limit(1).count():
                break
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return out.select("start_id", "target_id", F.size("hops").cast("int").alias("n_hops"), "hops")

    def path(self, start: int, target: int, depth: int = 3, via: list[str] | None = None) -> DataFrame:
        return self.paths(self.spark.createDataFrame([(start, target)], "start_id bigint, target_id bigint"), depth, via)

    def path_hops(self, path: DataFrame) -> DataFrame:
        """A row for each node of each path, in order, with its kind and label."""
        first = F.array(F.struct(F.lit(None).cast("string").alias("edge_kind"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("bigint").alias("edge_id"), F.col("start_id").alias("node")))
        each = path.select("start_id", "target_id", F.posexplode(F.concat(first, "hops")).alias("hop", "step")).select("start_id", "target_id", "hop", "step.*")
        names = self.nodes.select(F.col("id").alias("node"), F.col("kind").alias("node_kind"), label().alias("label"))
        return each.join(names, "node").select("start_id", "target_id", "hop", "node", "node_kind", "label", "edge_kind", "direction")

    def render(self, path: DataFrame) -> DataFrame:
        """Each path as one line: A >KIND> B <KIND< C  (n hops)."""
        step = F.concat(F.when(F.col("hop") == 0, "").otherwise(F.concat(F.lit(" "), "direction", "edge_kind", "direction", F.lit(" "))), F.concat_ws(":", "node_kind", "node"))
        lines = self.path_hops(path).groupBy("start_id", "target_id").agg(F.sort_array(F.collect_list(F.struct("hop", step.alias("text")))).alias("steps"))
        text = F.array_join(F.transform("steps", lambda s: s["text"]), "")
        n = F.size("steps") - 1
        return lines.select("start_id", "target_id", F.concat(text, F.lit("  ("), n.cast("string"), F.when(n == 1, " hop)").otherwise(" hops)")).alias("line"))

    # -- search ----------------------------------------------------------------------------------------------------

    def fuzzy(self, query: str, kind: str | None = None) -> DataFrame:
        """id, kind, label, score (best similarity of title, name, summary) and exact (the text of all properties has it)."""
        nodes = self.nodes if kind is None else self.nodes.filter(F.col("kind") == kind)
        score = F.greatest(*[jaro_winkler(property_text(k), query) for k in ("title", "name", "summary")])
        exact = F.col("properties").ilike("%" + query.replace("\\", "\\\\") + "%")
        return nodes.select("id", "kind", label("title", "name").alias("label"), score.alias("score"), exact.alias("exact"))

    def search(self, query: str, kind: str | None = None, limit: int = 10, least: float = 0.6) -> DataFrame:
        """Nodes by reciprocal rank of similarity above ``least``, plus a bonus for exact hits; ties go to the smaller id.

        Ranks over all hits come from ranges of them, never from one sorted partition (``numbered``)."""
        hits = self.fuzzy(query, kind).filter(F.col("score") > least).withColumn("below", -F.col("score"))
        ranked = numbered(hits, 0, "below", "id", name="rank")
        value = F.lit(1.0) / (F.lit(60.0) + F.col("rank").cast("double")) + F.when(F.col("exact"), F.lit(0.05)).otherwise(F.lit(0.0))
        return ranked.select("id", "kind", "label", value.alias("score")).orderBy(F.desc("score"), "id").limit(limit)

    def bm25(self, query: str, kind: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """id and score of nodes whose properties (keys included) hold words with the stems of the query's words. Words are
        runs of a-z and 0-9 in lower case; stop words count nowhere. A query without other words finds nothing."""
        nodes = self.nodes if kind is None else self.nodes.filter(F.col("kind") == kind)
        wanted = terms(query)
        docs = nodes.select("id", words(F.col("properties")).alias("words"))
        docs = docs.select("id", F.size("words").alias("n"), F.filter("words", lambda w: may_have_stem(w, wanted)).alias("hits"))
        total = docs.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
        hits = docs.select("id", "n", F.explode("hits").alias("word")).withColumn("stem", stems(F.col("word"))).filter(F.col("stem").isin(wanted))
        hits = hits.groupBy("id", "n", "stem").agg(F.count("*").alias("tf"))
        df = hits.groupBy("stem").agg(F.count("*").alias("df"))
        tf = F.col("tf").cast("double")
        idf = F.log(F.lit(1.0) + (F.lit(float(total["docs"])) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.lit(float(total["mean"] or 1.0))))
        return hits.join(F.broadcast(df), "stem").groupBy("id").agg(F.sum(part).alias("score"))

    def rrf3(self, query: str, kind: str | None = None, limit: int = 10) -> DataFrame:
        """Reciprocal ranks of BM25 (2.0), exact (1.5) and fuzzy (1.0) hits fused, each over its whole list."""
        fuzzy = settle(self.fuzzy(query, kind), "rrf")
        lists = [
            (2.0, self.bm25(query, kind).select("id", "score")),
            (1.5, fuzzy.filter("exact").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))),
            (1.0, fuzzy.filter("score > 0.6").select("id", "score")),
        ]
        parts = []
        for weight, hits in lists:
            ranked = numbered(hits.withColumn("below", -F.col("score")), 0, "below", "id", name="rank")
            parts.append(ranked.select("id", (F.lit(weight) / (F.lit(60.0) + F.col("rank").cast("double"))).alias("part")))
        fused = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("id").agg(F.sum("part").alias("score"))
        return fused.join(fuzzy.select("id", "kind", "label"), "id").select("id", "kind", "label", "score").orderBy(F.desc("score"), "id").limit(limit)

    # -- shorthands ------------------------------------------------------------------------------------------------

    def related(self, start: int, kind: str, limit: int = 30) -> DataFrame:
        """The nodes of the walk kind/~kind but the start itself, with how many neighbours they share with it, most first."""
        mine = self.edges.filter((F.col("kind") == kind) & (F.col("from_id") == start)).select("to_id").distinct()
        theirs = self.edges.filter((F.col("kind") == kind) & (F.col("from_id") != start)).select("from_id", "to_id").distinct()
        shared = theirs.join(mine, "to_id").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("shared"))
        return shared.orderBy(F.desc("shared"), "id").limit(limit)

    def timeline(self, kind: str, by: str, unit: str = "month") -> DataFrame:
        """Counts of a kind by a time property."""
        props = self.schema.node(kind)
        if by not in props:
            raise UnknownProperty(f"{kind} has no property {by}")
        at = F.date_trunc(unit, F.col(by)).cast("timestamp_ntz")
        return self.typed(kind).groupBy(at.alias("at")).agg(F.count("*").alias("n")).orderBy("at")


def compact() -> Column:
    """Kind:id "label" """
    return F.concat(ref(), F.lit(' "'), label(), F.lit('"'))
