"""Sessions with an assistant as graphs: from JSON lines, from tables of turns, or one by one."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound
from ..operators.graph import Graph
from ..schema import Schema

#: What a session is: its own id, then the tool, title and text that it began with, and the names of what it belongs to.
SESSION = "session_id string, tool string, title string, first_prompt string, started_at string, project string, branch string, model string"


@dataclass(frozen=True)
class Layout:
    """Which kinds and edges hold sessions: for each column of SESSION that is a node of its own, its kind, the property
    that names it, and the edge from the session to it."""

    session: str = "Session"
    links: tuple[tuple[str, str, str, str], ...] = (("project", "Project", "path", "IN_PROJECT"), ("branch", "Branch", "name", "ON_BRANCH"), ("model", "Model", "name", "USED_MODEL"))

    def link(self, column: str) -> tuple[str, str, str, str]:
        return next(x for x in self.links if x[0] == column)


def read_jsonl(spark: SparkSession, path: str, tool: str | None = None) -> DataFrame:
    """SESSION rows of transcripts, one JSON object a line: the first line of type user (by timestamp, then text) gives a
    session its branch, folder and first prompt, lines of type assistant its model. Lines of other types, without
    sessionId or that are no JSON are left out; a message's text is a string or the text parts of a list."""
    line = spark.read.text(path).select(F.try_parse_json("value").alias("j"))
    at = lambda p, kind="string": F.try_variant_get("j", p, kind)
    content = at("$.message.content", "variant")
    parts = F.try_variant_get(content, "$", "array<variant>")
    said = F.array_join(F.filter(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), lambda t: t.isNotNull()), "\n")
    text = F.when(F.schema_of_variant(content) == "STRING", at("$.message.content")).otherwise(said)
    rows = line.select(at("$.sessionId").alias("session_id"), at("$.type").alias("type"), at("$.timestamp").alias("at"), at("$.gitBranch").alias("branch"), at("$.cwd").alias("project"), text.alias("text"), at("$.message.model").alias("model"))
    rows = rows.filter(F.col("session_id").isNotNull() & F.col("type").isin("user", "assistant"))
    user = F.when(F.col("type") == "user", F.struct(F.col("at").isNull(), "at", "text", "branch", "project"))
    found = rows.groupBy("session_id").agg(F.min(user).alias("u"), F.min("at").alias("started_at"), F.min(F.when(F.col("type") == "assistant", F.col("model"))).alias("model"))
    return found.select("session_id", F.lit(tool).cast("string").alias("tool"), title(F.col("u.text")).alias("title"), F.col("u.text").alias("first_prompt"), "started_at", F.col("u.project").alias("project"), F.col("u.branch").alias("branch"), "model")


def from_turns(turns: DataFrame, tool: str | None = None) -> DataFrame:
    """SESSION rows of a table of turns (conv_id, turn, role, text): the user's first turn is the first prompt."""
    user = F.when(F.col("role") == "user", F.struct("turn", "text"))
    found = turns.filter(F.col("conv_id").isNotNull()).groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(F.min(user).alias("u"))
    none = F.lit(None).cast("string")
    return found.select("session_id", F.lit(tool).cast("string").alias("tool"), title(F.col("u.text")).alias("title"), F.col("u.text").alias("first_prompt"), *[none.alias(c) for c in ("started_at", "project", "branch", "model")])


def title(text: Column, most: int = 80) -> Column:
    """The first line that says something, at most ``most`` characters of it."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    return F.substring(F.trim(line), 1, most)


def as_graph(sessions: DataFrame, schema: Schema, layout: Layout = Layout()) -> Graph:
    """Rows of SESSION as a graph of their own, to be merged into another. Properties that the schema lacks are left out,
    and so are sessions of equal session_id but the first by title."""
    known = set(schema.node(layout.session))
    rows = sessions.groupBy("session_id").agg(F.min(F.struct("title", *[c for c in sessions.columns if c not in ("session_id", "title")])).alias("r")).select("session_id", "r.*")
    own = F.to_json(F.struct(*[F.col(c) for c in sorted(sessions.columns) if c in known]))
    key = lambda kind, value: F.xxhash64(F.lit(kind), value)
    now = F.localtimestamp()
    stamped = lambda df, kind, i, p: df.select(i.alias("id"), F.lit(kind).alias("kind"), p.alias("properties"), now.alias("created_at"), now.alias("updated_at"))
    nodes, edges = [stamped(rows, layout.session, key(layout.session, F.col("session_id")), own)], []
    for column, kind, name, edge in layout.links:
        if kind not in schema.nodes:
            continue
        there = rows.filter(F.col(column).isNotNull())
        nodes.append(stamped(there.select(column).distinct(), kind, key(kind, F.col(column)), F.to_json(F.struct(F.col(column).alias(name)))))
        if edge in schema.edges:
            edges.append(there.select(F.xxhash64(F.lit(edge), "session_id").alias("id"), F.lit(edge).alias("kind"), key(layout.session, F.col("session_id")).alias("from_id"), key(kind, F.col(column)).alias("to_id"),
                                      F.lit(layout.session).alias("from_kind"), F.lit(kind).alias("to_kind"), F.lit("{}").alias("properties"), now.alias("created_at")))
    empty = Graph.empty(sessions.sparkSession, schema)
    return empty.of(nodes=functools.reduce(DataFrame.unionByName, nodes), edges=functools.reduce(DataFrame.unionByName, edges, empty.edges))


def sessions(g: Graph, layout: Layout = Layout(), limit: int | None = 30, **named: str) -> DataFrame:
    """Sessions, the newest first: of a tool, and of a project, branch or model by name (``Layout.links``)."""
    found = g.find(layout.session, *([f"tool={named['tool']}"] if "tool" in named else []), limit=None)
    for column, value in named.items():
        if column == "tool":
            continue
        _, kind, name, edge = layout.link(column)
        ends = g.table(kind).filter(F.col(name) == value).select(F.col("id").alias("start_id"))
        found = found.join(g.walk_from(ends, f"~{edge}").select("id"), "id", "left_semi")
    found = found.orderBy(F.col("id").desc())
    return found if limit is None else found.limit(limit)


def timeline(g: Graph, layout: Layout = Layout(), last: int = 30, follows: str | None = None, **named: str) -> DataFrame:
    """day, id, kind, properties and follows (ids that the session continues along the edge ``follows``) of the newest
    sessions, by creation."""
    found = sessions(g, layout, None, **named).orderBy(F.desc("created_at"), F.desc("id")).limit(last)
    out = found.select(F.to_date("created_at").alias("day"), "id", "kind", "properties", "created_at")
    if follows is None:
        return out.withColumn("follows", F.array().cast("array<bigint>")).orderBy(F.desc("created_at"), F.desc("id"))
    g.schema.edge(follows)
    steps = g.edges.filter(F.col("kind") == follows).groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_set("to_id")).alias("follows"))
    return out.join(steps, "id", "left").withColumn("follows", F.coalesce("follows", F.array().cast("array<bigint>"))).orderBy(F.desc("created_at"), F.desc("id"))


def credentials(spark: SparkSession, environ: dict[str, str], settings: dict[str, str]) -> None:
    """Give Spark's file systems what they need to reach a store: for each of ``settings`` (Hadoop setting -> variable of
    the environment). A variable that is not set is an error that names it."""
    for setting, variable in settings.items():
        if not environ.get(variable):
            raise NotFound(f"{variable} is not set")
        spark._jsc.hadoopConfiguration().set(setting, environ[variable])
