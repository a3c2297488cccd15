"""Queries over the business-table graph, and the same results in SQL over the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import scratch
from ..filters import conjunction, either, lacking
from ..functions.text import label, ref
from ..operators import changes
from ..operators.graph import Graph, compact
from ..schema import Schema, edge_errors, node_errors, property_text
from ..sources import transcripts
from ..sources.snapshots import export, export_json, import_json, load
from ..sources.tables import SCHEMA, STEP, graph_from_tables, node_id

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_B = STEP
NODES = f"""n AS (
  SELECT {_B} * 1 + r_regionkey AS id, 'Region' AS kind, r_name AS name, NULL::DOUBLE AS acctbal, NULL AS mktsegment, NULL AS brand, NULL AS ptype, NULL::BIGINT AS size, NULL AS status, NULL::DOUBLE AS totalprice, NULL::TIMESTAMP AS orderdate, NULL AS priority, NULL AS lang, NULL AS source, NULL::BIGINT AS n_chars FROM region
  UNION ALL SELECT {_B} * 2 + n_nationkey, 'Nation', n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT {_B} * 3 + c_custkey, 'Customer', c_name, c_acctbal, c_mktsegment, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer
  UNION ALL SELECT {_B} * 4 + s_suppkey, 'Supplier', s_name, s_acctbal, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT {_B} * 5 + p_partkey, 'Part', p_name, NULL, NULL, p_brand, p_type, p_size, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part
  UNION ALL SELECT {_B} * 6 + o_orderkey, 'Order', NULL, NULL, NULL, NULL, NULL, NULL, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, NULL, NULL, NULL FROM orders
  UNION ALL SELECT {_B} * 7 + doc_id, 'Document', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, lang, source, n_chars FROM documents
  UNION ALL SELECT DISTINCT {_B} * 8 + conv_id, 'Conversation', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM conversations
  UNION ALL SELECT DISTINCT {_B} * 9 + user_id, 'User', 'user-' || user_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM events
)"""
EDGES = f"""e AS (
  SELECT {_B} * 1 + n_nationkey AS id, 'IN_REGION' AS kind, {_B} * 2 + n_nationkey AS from_id, {_B} * 1 + n_regionkey AS to_id, 'Nation' AS from_kind, 'Region' AS to_kind, NULL::DOUBLE AS quantity, NULL::INTEGER AS linenumber FROM nation
  UNION ALL SELECT {_B} * 2 + c_custkey, 'IN_NATION', {_B} * 3 + c_custkey, {_B} * 2 + c_nationkey, 'Customer', 'Nation', NULL, NULL FROM customer
  UNION ALL SELECT {_B} * 3 + s_suppkey, 'IN_NATION', {_B} * 4 + s_suppkey, {_B} * 2 + s_nationkey, 'Supplier', 'Nation', NULL, NULL FROM supplier
  UNION ALL SELECT {_B} * 4 + o_orderkey, 'PLACED', {_B} * 3 + o_custkey, {_B} * 6 + o_orderkey, 'Customer', 'Order', NULL, NULL FROM orders
  UNION ALL SELECT {_B} * 5 + l_orderkey * 8 + l_linenumber, 'CONTAINS', {_B} * 6 + l_orderkey, {_B} * 5 + l_partkey, 'Order', 'Part', l_quantity, l_linenumber FROM lineitem
  UNION ALL SELECT {_B} * 6 + l_orderkey * 8 + l_linenumber, 'SOLD_BY', {_B} * 5 + l_partkey, {_B} * 4 + l_suppkey, 'Part', 'Supplier', l_quantity, l_linenumber FROM lineitem
)"""
#: Text of a part's, region's or nation's properties.
PART_TEXT = """'{"brand":"' || brand || '","name":"' || name || '","ptype":"' || ptype || '","size":' || size || '}'"""
CUSTOMER, OTHER, NATION, PART = node_id("Customer", 1), node_id("Customer", 2), node_id("Nation", 3), node_id("Part", 1)


def query(name: str, sql: str | None = None, nodes: bool = True, edges: bool = False, recursive: str = ""):
    """Register a function of a graph; ``sql`` selects from n (nodes) and e (edges)."""
    tables = ([NODES] if nodes else []) + ([EDGES] if edges else []) + ([recursive] if recursive else [])

    def put(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(graph_from_tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(tables)} {sql}"
        return f

    return put


# -- scans and lookups

query("scan_nodes", "SELECT id, kind FROM n")(lambda g: g.nodes.select("id", "kind"))
query("scan_edges", "SELECT id, kind, from_id, to_id, from_kind, to_kind FROM e", False, True)(lambda g: g.edges.select("id", "kind", "from_id", "to_id", "from_kind", "to_kind"))
query("typed_view", "SELECT id, status, totalprice, orderdate, priority FROM n WHERE kind = 'Order'")(lambda g: g.typed("Order").select("id", "status", "totalprice", "orderdate", "priority"))
query("get_by_id", f"SELECT id, kind, name FROM n WHERE id = {CUSTOMER}")(lambda g: g.by_id(CUSTOMER).select("id", "kind", property_text("name").alias("name")))
query("resolve_ref", f"SELECT id, kind FROM n WHERE id = {PART} AND kind = 'Part'")(lambda g: g.resolve("Part", PART).select("id", "kind"))
query("get_edge", f"SELECT id, kind, from_id, to_id FROM e WHERE from_id = {CUSTOMER} AND kind = 'IN_NATION' AND to_id = (SELECT to_id FROM e WHERE from_id = {CUSTOMER} AND kind = 'IN_NATION') ORDER BY id LIMIT 1", False, True)(
    lambda g: g.edge(CUSTOMER, "IN_NATION", g.incident(CUSTOMER, kind="IN_NATION").select("to_id").first()[0]).select("id", "kind", "from_id", "to_id")
)
query("list_edges", f"SELECT id, kind, from_id, to_id FROM e WHERE from_id = {CUSTOMER} OR to_id = {CUSTOMER}", False, True)(lambda g: g.incident(CUSTOMER).select("id", "kind", "from_id", "to_id").orderBy("id"))
_GROUPED = """SELECT CASE WHEN from_id = {x} THEN 'out' ELSE 'in' END AS direction, kind,
  string_agg(CASE WHEN from_id = {x} THEN to_kind || ':' || to_id ELSE from_kind || ':' || from_id END, ',' ORDER BY CASE WHEN from_id = {x} THEN to_kind || ':' || to_id ELSE from_kind || ':' || from_id END) AS others
  FROM e WHERE (from_id = {x} OR to_id = {x}) {more} GROUP BY 1, 2"""
query("edges_grouped", _GROUPED.format(x=CUSTOMER, more=""), False, True)(lambda g: g.grouped(CUSTOMER))
query("edges_out", _GROUPED.format(x=NATION, more=f"AND from_id = {NATION}"), False, True)(lambda g: g.grouped(NATION, outgoing=True, incoming=False))
query("edges_in", _GROUPED.format(x=NATION, more=f"AND from_id <> {NATION}"), False, True)(lambda g: g.grouped(NATION, outgoing=False, incoming=True))
query("edges_kind", _GROUPED.format(x=PART, more="AND kind = 'SOLD_BY'"), False, True)(lambda g: g.grouped(PART, kind="SOLD_BY"))
query("get_full", f"SELECT n.kind || ':' || n.id AS ref, n.name AS label, x.* FROM n LEFT JOIN ({_GROUPED.format(x=CUSTOMER, more='')}) x ON true WHERE n.id = {CUSTOMER}", True, True)(lambda g: g.full("Customer", CUSTOMER))


@query("export_roundtrip", "SELECT 'nodes' AS part, kind, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edges', kind, count(*) FROM e GROUP BY kind", True, True)
def _export(g: Graph) -> DataFrame:
    back = load(g.spark, export(g, scratch(g.spark, "export")), g.schema)
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("part"), "kind", "n")
    return count(back.nodes, "nodes").unionByName(count(back.edges, "edges"))


@query("export_json", "SELECT kind, count(*) AS n, min(name) AS least, sum(size) AS sizes FROM n WHERE kind IN ('Part', 'Nation', 'Order') GROUP BY kind")
def _export_json(g: Graph) -> DataFrame:
    some = g.of(nodes=g.nodes.filter(F.col("kind").isin("Part", "Nation", "Order")), edges=g.edges.filter("kind = 'IN_REGION'"))
    back = import_json(g.spark, export_json(some, scratch(g.spark, "json")), g.schema).nodes
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.min(property_text("name")).alias("least"), F.sum(property_text("size").cast("bigint")).alias("sizes"))


_STORED = "SELECT id, name, size FROM n WHERE kind = 'Part' AND size > 25 AND brand = 'Brand#11'"
query("stored_filter", _STORED)(lambda g: load(g.spark, export(g.of(nodes=g.nodes.filter("kind IN ('Part', 'Order')"), edges=g.edges.limit(0)), scratch(g.spark, "stored")), g.schema).table("Part").filter("size > 25 AND brand = 'Brand#11'").select("id", "name", "size"))


# -- projections and filters

query("project", "SELECT id, name, size * 2 AS twice, CASE WHEN size > 25 THEN 'large' ELSE 'small' END AS class FROM n WHERE kind = 'Part'")(
    lambda g: g.typed("Part").select("id", "name", (F.col("size") * 2).alias("twice"), F.when(F.col("size") > 25, "large").otherwise("small").alias("class"))
)
QUERIES["json_extract"] = lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
ORACLE_SQL["json_extract"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
for _name, _filter, _where in (
    ("filter_eq", "brand=Brand#11", "brand = 'Brand#11'"),
    ("filter_ne", "brand!=Brand#11", "brand <> 'Brand#11'"),
    ("filter_gt", "size>25", "size > 25"),
    ("filter_ge", "size>=25", "size >= 25"),
    ("filter_lt", "size<25", "size < 25"),
    ("filter_le", "size<=25", "size <= 25"),
    ("filter_contains", "name~EA", "name ILIKE '%EA%'"),
    ("filter_prefix", "name^RED", "name ILIKE 'RED%'"),
    ("find_and", "size>10,size<=30,name~e", "size > 10 AND size <= 30 AND name ILIKE '%e%'"),
):
    query(_name, f"SELECT id, name FROM n WHERE kind = 'Part' AND {_where}")(lambda g, f=_filter: g.find("Part", f, limit=None).select("id", property_text("name").alias("name")))
query("filter_float", "SELECT id, acctbal FROM n WHERE kind = 'Customer' AND acctbal > 5000.5")(lambda g: g.find("Customer", "acctbal>5000.5", limit=None).select("id", property_text("acctbal").cast("double").alias("acctbal")))
query("filter_time", "SELECT id, orderdate FROM n WHERE kind = 'Order' AND orderdate >= '1997-01-01'")(lambda g: g.find("Order", "orderdate>=1997-01-01", limit=None).select("id", property_text("orderdate").cast("timestamp_ntz").alias("orderdate")))
query("find_order_asc", "SELECT id, name FROM n WHERE kind = 'Part' ORDER BY name, id LIMIT 30")(lambda g: g.find("Part", order="name:asc").select("id", property_text("name").alias("name")))
query("find_order_desc", "SELECT id, name FROM n WHERE kind = 'Part' ORDER BY name DESC, id LIMIT 30")(lambda g: g.find("Part", order="name").select("id", property_text("name").alias("name")))
query("find_order_case", "SELECT id, name FROM n WHERE kind = 'Part' ORDER BY name DESC, id LIMIT 30")(lambda g: g.find("Part", order="name:DESC").select("id", property_text("name").alias("name")))
query("find_or_not", "SELECT id FROM n WHERE kind = 'Part' AND (size < 5 OR NOT name ILIKE '%e%')")(
    lambda g: g.table("Part").filter(either(conjunction(["size<5"], g.schema.node("Part")), ~conjunction(["name~e"], g.schema.node("Part")))).select("id")
)
query("find_lacking", "SELECT id, kind FROM n WHERE brand IS NULL")(lambda g: g.nodes.filter(lacking("brand")).select("id", "kind"))
query("find_limit", "SELECT id FROM n WHERE kind = 'Order' ORDER BY id DESC LIMIT 7")(lambda g: g.find("Order", limit=7).select("id"))
query("find_compact", """SELECT kind || ':' || id || ' "' || name || '"' AS line FROM n WHERE kind = 'Nation'""")(lambda g: g.find("Nation", limit=None).select(compact().alias("line")))
query("find_quiet", "SELECT id FROM n WHERE kind = 'Supplier'")(lambda g: g.find("Supplier", limit=None).select("id"))
query("label", "SELECT id, coalesce(name, '') AS label, kind || ':' || id AS ref FROM n")(lambda g: g.nodes.select("id", label().alias("label"), ref().alias("ref")))

# -- counts

query("node_count", "SELECT count(*) AS n FROM n")(lambda g: g.nodes.agg(F.count("*").alias("n")))
query("edge_count", "SELECT count(*) AS n FROM e", False, True)(lambda g: g.edges.agg(F.count("*").alias("n")))
query("count_kind", "SELECT count(*) AS n FROM n WHERE kind = 'Part'")(lambda g: g.count("Part"))
query("count_by", "SELECT mktsegment AS value, count(*) AS n FROM n WHERE kind = 'Customer' GROUP BY 1")(lambda g: g.count("Customer", by="mktsegment"))
query("count_where", "SELECT status AS value, count(*) AS n FROM n WHERE kind = 'Order' AND totalprice > 100000 GROUP BY 1")(lambda g: g.count("Order", "totalprice>100000", by="status"))
query("kinds", "SELECT kind, count(*) AS n FROM n GROUP BY 1")(lambda g: g.kinds())
query("edge_kinds", "SELECT kind, count(*) AS n FROM e GROUP BY 1", False, True)(lambda g: g.edge_kinds())
query("stats", "SELECT 'node' AS what, kind, count(*) AS n FROM n GROUP BY ROLLUP (kind) UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY ROLLUP (kind)", True, True)(lambda g: g.stats())

# -- walks

_HOP = "SELECT DISTINCT {far} AS id FROM e WHERE {near} IN ({start}){kind}"


def _walk_sql(path: str, start: str) -> str:
    for step in path.split("/"):
        near, far = ("to_id", "from_id") if step[0] == "~" else ("from_id", "to_id")
        kind = "" if step.lstrip("~") == "*" else f" AND kind = '{step.lstrip('~')}'"
        start = _HOP.format(near=near, far=far, start=start, kind=kind)
    return f"SELECT id, kind FROM n WHERE id IN ({start})"


for _name, _start, _path in (
    ("walk_1hop", CUSTOMER, "PLACED"),
    ("walk_2hop", CUSTOMER, "PLACED/CONTAINS"),
    ("walk_3hop", CUSTOMER, "PLACED/CONTAINS/SOLD_BY"),
    ("walk_reverse", NATION, "~IN_NATION"),
    ("walk_wildcard", CUSTOMER, "*"),
    ("walk_rev_wildcard", PART, "~*"),
    ("walk_cycle", CUSTOMER, "IN_NATION/~IN_NATION"),
    ("walk_dedup", PART, "~CONTAINS/CONTAINS"),
):
    query(_name, _walk_sql(_path, str(_start)), True, True)(lambda g, s=_start, p=_path: g.walk(s, p, limit=None).select("id", "kind"))
query("walk_limit", _walk_sql("PLACED/CONTAINS", str(CUSTOMER)) + " ORDER BY id LIMIT 5", True, True)(lambda g: g.walk(CUSTOMER, "PLACED/CONTAINS", limit=5).select("id", "kind"))
query("walk_where", _walk_sql("PLACED/CONTAINS", str(CUSTOMER)) + " AND brand = 'Brand#11'", True, True)(lambda g: g.walk(CUSTOMER, "PLACED/CONTAINS", "brand=Brand#11", limit=None).select("id", "kind"))
query("walk_batch", "SELECT DISTINCT a.from_id AS start_id, b.to_id AS id FROM e a JOIN e b ON a.to_id = b.from_id WHERE a.kind = 'PLACED' AND b.kind = 'CONTAINS'", False, True)(
    lambda g: g.walk_from(g.nodes.filter("kind = 'Customer'").select(F.col("id").alias("start_id")), "PLACED/CONTAINS")
)

# -- paths

_ADJ = "adj AS MATERIALIZED (SELECT from_id AS a, to_id AS b, kind FROM e WHERE kind IN ({via}) UNION ALL SELECT to_id, from_id, kind FROM e WHERE kind IN ({via}))"


def _reach(start: int, via: str, depth: int) -> str:
    kinds = ", ".join(f"'{v}'" for v in via.split(","))
    return _ADJ.format(via=kinds) + f", reach AS (SELECT {start} AS id, 0 AS d UNION SELECT adj.b, d + 1 FROM reach JOIN adj ON adj.a = reach.id WHERE d < {depth})"


_DEEP = "PLACED,CONTAINS,IN_NATION"
_SHORT = "SELECT CAST({a} AS BIGINT) AS start_id, CAST({b} AS BIGINT) AS target_id, min(d) AS n_hops FROM reach WHERE id = {b} HAVING count(*) > 0"
for _name, _a, _b, _via, _depth in (
    ("path_via", CUSTOMER, PART, "PLACED,CONTAINS", 4),
    ("path_none", CUSTOMER, OTHER, "IN_REGION", 3),
    ("path_self", CUSTOMER, CUSTOMER, _DEEP, 3),
):
    query(_name, _SHORT.format(a=_a, b=_b), False, True, _reach(_a, _via, _depth))(lambda g, a=_a, b=_b, v=_via, d=_depth: g.path(a, b, d, v.split(",")).select("start_id", "target_id", "n_hops"))
_UP = ["PLACED", "IN_NATION", "IN_REGION"]
_FIRST = f"(SELECT min({_B} * 6 + o_orderkey) FROM orders)"
_LADDER = f"""SELECT {_B} * 6 + o_orderkey AS o, {_B} * 3 + o_custkey AS c, {_B} * 2 + c_nationkey AS n, {_B} * 1 + n_regionkey AS r, c_name, n_name, r_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE {_B} * 6 + o_orderkey = {_FIRST}"""


def _up(g: Graph) -> DataFrame:
    """Paths from the first order to any region: by its customer and nation."""
    first = g.table("Order").agg(F.min("id")).first()[0] or -1
    return g.paths(g.table("Region").select(F.lit(first).alias("start_id"), F.col("id").alias("target_id")), 3, _UP)


query("path_shortest", f"SELECT o AS start_id, r AS target_id, 3 AS n_hops FROM ({_LADDER})", False, False, "nothing AS (SELECT 1)")(lambda g: _up(g).select("start_id", "target_id", "n_hops"))
query("path_hops", f"""SELECT start_id, target_id, CAST(hop AS INTEGER) AS hop, node, node_kind, label, edge_kind, direction FROM (
  SELECT o AS start_id, r AS target_id, 0 AS hop, o AS node, 'Order' AS node_kind, '' AS label, NULL AS edge_kind, NULL AS direction FROM ({_LADDER})
  UNION ALL SELECT o, r, 1, c, 'Customer', c_name, 'PLACED', '<' FROM ({_LADDER}) UNION ALL SELECT o, r, 2, n, 'Nation', n_name, 'IN_NATION', '>' FROM ({_LADDER})
  UNION ALL SELECT o, r, 3, r, 'Region', r_name, 'IN_REGION', '>' FROM ({_LADDER}))""", False, False, "nothing AS (SELECT 1)")(lambda g: g.path_hops(_up(g)))
query("path_render", f"SELECT o AS start_id, r AS target_id, 'Order:' || o || ' <PLACED< Customer:' || c || ' >IN_NATION> Nation:' || n || ' >IN_REGION> Region:' || r || '  (3 hops)' AS line FROM ({_LADDER})", False, False, "nothing AS (SELECT 1)")(
    lambda g: g.render(_up(g))
)


query("related", "SELECT b.from_id AS id, count(*) AS shared FROM (SELECT DISTINCT to_id FROM e WHERE kind = 'SOLD_BY' AND from_id = {0}) a JOIN (SELECT DISTINCT from_id, to_id FROM e WHERE kind = 'SOLD_BY' AND from_id <> {0}) b ON a.to_id = b.to_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30".format(PART), False, True)(lambda g: g.related(PART, "SOLD_BY"))
query("timeline", "SELECT date_trunc('month', orderdate)::TIMESTAMP AS at, count(*) AS n FROM n WHERE kind = 'Order' GROUP BY 1")(lambda g: g.timeline("Order", "orderdate"))
query("conversation_view", f"""SELECT {_B} * 8 + conv_id AS id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_prompt, count(*) AS turns FROM conversations GROUP BY conv_id""", False, False, "nothing AS (SELECT 1)")(
    lambda g: g.typed("Conversation").select("id", "first_prompt", "turns")
)
_TALKS = Schema.parse("""
[nodes.Session]
session_id = "string"
title = "string?"
first_prompt = "string?"
tool = "string?"
[natural_keys]
Session = ["session_id"]
""")


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = transcripts.as_graph(transcripts.from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "chat"), _TALKS)
    once = changes.merge(Graph.empty(spark, _TALKS), talks)
    return changes.merge(once, talks).typed("Session").select("id", "session_id", "first_prompt", "tool")


QUERIES["ingest_conversations"] = _ingested
ORACLE_SQL["ingest_conversations"] = """SELECT row_number() OVER (ORDER BY CAST(conv_id AS VARCHAR)) AS id, CAST(conv_id AS VARCHAR) AS session_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_prompt, 'chat' AS tool FROM conversations GROUP BY conv_id"""

# -- search

_WORD = "red gear"
_FUZZY = f"SELECT id, kind, coalesce(name, '') AS label, jaro_winkler_similarity(name, '{_WORD}') AS score, ({PART_TEXT}) ILIKE '%{_WORD}%' AS exact FROM n WHERE kind = 'Part'"
query("fuzzy_score", f"SELECT id, score FROM ({_FUZZY})")(lambda g: g.fuzzy(_WORD, "Part").select("id", "score"))
query("exact_match", f"SELECT id, exact FROM ({_FUZZY})")(lambda g: g.fuzzy(_WORD, "Part").select("id", "exact"))
_RANKED = f"SELECT id, kind, label, 1.0::DOUBLE / (60.0::DOUBLE + row_number() OVER (ORDER BY score DESC, id)) + CASE WHEN exact THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS score FROM ({_FUZZY}) WHERE score > 0.6"
query("search", f"SELECT * FROM ({_RANKED}) ORDER BY score DESC, id LIMIT 10")(lambda g: g.search(_WORD, "Part"))
query("search_kind", f"SELECT id, kind, name AS label, 1.0::DOUBLE / (60.0::DOUBLE + row_number() OVER (ORDER BY jaro_winkler_similarity(name, 'NATION_1') DESC, id)) + CASE WHEN name ILIKE '%NATION_1%' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS score FROM n WHERE kind = 'Nation' AND jaro_winkler_similarity(name, 'NATION_1') > 0.6 ORDER BY 4 DESC, 1 LIMIT 5")(
    lambda g: g.search("NATION_1", "Nation", limit=5)
)
query("search_rank", f"SELECT id, score FROM ({_RANKED}) ORDER BY score DESC, id LIMIT 50")(lambda g: g.search(_WORD, "Part", limit=50).select("id", "score"))
_BM25 = f"""w AS (SELECT id, list_filter(string_split_regex(lower({PART_TEXT}), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM n WHERE kind = 'Part'),
  t AS (SELECT id, term, len(ws) AS n, len(list_filter(ws, lambda x: x = term OR x = term || 's' OR x = term || 'ed')) AS tf FROM w, (VALUES ('red'), ('gear')) AS q(term)),
  d AS (SELECT term, count(*) AS df FROM t WHERE tf > 0 GROUP BY 1),
  bm AS (SELECT id, sum(ln(1 + ((SELECT count(*) FROM w) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / (SELECT avg(len(ws)) FROM w)))) AS score
    FROM t JOIN d USING (term) WHERE tf > 0 GROUP BY id)"""
query("bm25", "SELECT id, score FROM bm", recursive=_BM25)(lambda g: g.bm25("the red gears", "Part"))
query("rrf3", f"""SELECT id, any_value(f.kind) AS kind, any_value(f.label) AS label, sum(part) AS score FROM (
  SELECT id, 2.0::DOUBLE / (60.0::DOUBLE + row_number() OVER (ORDER BY round(score, 9) DESC, id)) AS part FROM bm
  UNION ALL SELECT id, 1.5::DOUBLE / (60.0::DOUBLE + row_number() OVER (ORDER BY coalesce(score, 0) DESC, id)) FROM f WHERE exact
  UNION ALL SELECT id, 1.0::DOUBLE / (60.0::DOUBLE + row_number() OVER (ORDER BY score DESC, id)) FROM f WHERE score > 0.6
) JOIN f USING (id) GROUP BY id ORDER BY score DESC, id LIMIT 10""", recursive=f"{_BM25}, f AS ({_FUZZY})")(lambda g: g.rrf3(_WORD, "Part"))

# -- changes

_KEYED = "SELECT id, kind, CASE WHEN kind IN ('Region', 'Nation', 'Customer', 'Supplier', 'User') THEN name WHEN kind = 'Part' THEN name || chr(1) || brand || chr(1) || ptype || chr(1) || size END AS nk FROM n"
query("natural_key", f"SELECT id, nk FROM ({_KEYED}) WHERE nk IS NOT NULL")(
    lambda g: g.nodes.filter(F.col("kind").isin("Region", "Nation", "Customer", "Supplier", "User", "Part")).select("id", changes.natural_key(g.schema).alias("nk"))
)


@query("add_nodes", "SELECT kind, count(*) AS n, count(DISTINCT id) AS ids, max(id) AS last FROM (SELECT id, kind FROM n UNION ALL SELECT (SELECT max(id) FROM n) + row_number() OVER (ORDER BY r_name), 'Region' FROM region) GROUP BY 1")
def _add(g: Graph) -> DataFrame:
    rows = g.typed("Region").select(F.lit("Region").alias("kind"), F.to_json(F.struct(F.concat(F.lit("New "), "name").alias("name"))).alias("properties"))
    return changes.add_nodes(g, rows).nodes.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("id").alias("last"))


@query("add_many", "SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) - (SELECT max(id) FROM n) AS first, max(id) - (SELECT max(id) FROM n) AS last FROM (SELECT (SELECT max(id) FROM n) + row_number() OVER () AS id FROM lineitem)")
def _add_many(g: Graph) -> DataFrame:
    rows = g.edges.filter("kind = 'CONTAINS'").select(F.lit("User").alias("kind"), F.to_json(F.struct(F.concat(F.lit("line-"), F.col("id").cast("string")).alias("name"))).alias("properties"))
    last = g.nodes.agg(F.max("id")).first()[0]
    return changes.new_nodes(g, rows).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), (F.min("id") - last).alias("first"), (F.max("id") - last).alias("last"))


#: Parts with a key more than the schema has, a value that does not cast, or text that is no JSON.
def _strange(g: Graph) -> DataFrame:
    size = property_text("size").cast("bigint")
    text = F.when(size % 3 == 0, F.regexp_replace("properties", "^.", '{"extra":1.50,')).when(size % 3 == 1, F.regexp_replace("properties", '"size":[0-9]+', '"size":"wide"')).otherwise(F.lit("not json"))
    return g.nodes.filter("kind = 'Part'").withColumn("properties", text)


query("set_merge", "SELECT id, CASE WHEN size % 3 = 0 THEN 1.5 END AS extra, CASE WHEN size % 3 = 0 THEN CAST(size AS VARCHAR) WHEN size % 3 = 1 THEN 'wide' END AS size, CASE WHEN size % 3 < 2 THEN brand END AS brand, 'new' AS name, CAST(NULL AS VARCHAR) AS ptype FROM n WHERE kind = 'Part'")(
    lambda g: changes.set_where(_strange(g), F.lit(True), {"name": "new", "ptype": None}).select("id", property_text("extra").cast("double").alias("extra"), *[property_text(c).alias(c) for c in ("size", "brand", "name", "ptype")])
)
query("validate_strange", "SELECT id, CASE size % 3 WHEN 0 THEN 'unknown property: extra' WHEN 1 THEN 'not int: size' ELSE 'properties are no JSON object' END AS errors FROM n WHERE kind = 'Part'")(
    lambda g: _strange(g).select("id", F.array_join(node_errors(g.schema), "|").alias("errors"))
)
query("rekind", f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN id = {node_id('Nation', 3)} THEN 'Region' ELSE kind END AS kind FROM n WHERE kind IN ('Nation', 'Region')) GROUP BY 1 UNION ALL SELECT to_kind || '<', count(*) FROM (SELECT CASE WHEN to_id = {NATION} THEN 'Region' ELSE to_kind END AS to_kind FROM e WHERE kind = 'IN_NATION') GROUP BY 1", True, True)(
    lambda g: _rekinded(changes.rekind(g, "Nation", NATION, "Region"))
)


def _rekinded(g: Graph) -> DataFrame:
    ends = g.edges.filter("kind = 'IN_NATION'").groupBy(F.concat("to_kind", F.lit("<")).alias("kind")).agg(F.count("*").alias("n"))
    return g.nodes.filter("kind IN ('Nation', 'Region')").groupBy("kind").agg(F.count("*").alias("n")).unionByName(ends)


query("rm_cascade", f"SELECT 'node' AS what, kind, count(*) AS n FROM n WHERE id <> {CUSTOMER} GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e WHERE from_id <> {CUSTOMER} AND to_id <> {CUSTOMER} GROUP BY kind", True, True)(
    lambda g: changes.remove_node(g, "Customer", CUSTOMER).stats().filter("kind IS NOT NULL")
)
query("rm_many", "SELECT kind, count(*) AS n FROM e WHERE from_kind <> 'Supplier' AND to_kind <> 'Supplier' GROUP BY 1", False, True)(lambda g: changes.remove_nodes(g, g.nodes.filter("kind = 'Supplier'")).edge_kinds())


@query("link", "SELECT kind, count(*) AS n, max(id) AS last FROM (SELECT id, kind FROM e UNION ALL SELECT (SELECT max(id) FROM e) + row_number() OVER (ORDER BY id), kind FROM e WHERE kind = 'IN_REGION') GROUP BY 1", False, True)
def _link(g: Graph) -> DataFrame:
    rows = g.edges.filter("kind = 'IN_REGION'").select("kind", "from_id", "to_id", F.lit("{}").alias("properties"))
    return changes.link(g, rows).edges.groupBy("kind").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@query("link_many", "SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) - (SELECT max(id) FROM e) AS first, max(id) - (SELECT max(id) FROM e) AS last FROM (SELECT (SELECT max(id) FROM e) + row_number() OVER () AS id FROM e WHERE kind = 'SOLD_BY')", False, True)
def _link_many(g: Graph) -> DataFrame:
    last = g.edges.agg(F.max("id")).first()[0]
    new = changes.new_edges(g, g.edges.filter("kind = 'SOLD_BY'").select("kind", "from_id", "to_id", "properties"))
    return new.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), (F.min("id") - last).alias("first"), (F.max("id") - last).alias("last"))


_SOLD = f"(SELECT min(to_id) FROM e WHERE kind = 'SOLD_BY' AND from_id = {PART})"


def _sold(g: Graph) -> int:
    return g.edges.filter((F.col("kind") == "SOLD_BY") & (F.col("from_id") == PART)).agg(F.min("to_id")).first()[0]


query("edge_set", f"SELECT id, CASE WHEN to_id = {_SOLD} THEN 1.5 ELSE quantity END AS quantity FROM e WHERE kind = 'SOLD_BY' AND from_id = {PART}", False, True)(
    lambda g: changes.set_edge(g, PART, "SOLD_BY", _sold(g), {"quantity": 1.5}).edges.filter((F.col("kind") == "SOLD_BY") & (F.col("from_id") == PART)).select("id", property_text("quantity").cast("double").alias("quantity"))
)
query("unlink", f"SELECT id FROM e WHERE kind = 'SOLD_BY' AND from_id = {PART} AND to_id <> {_SOLD}", False, True)(
    lambda g: changes.unlink(g, PART, "SOLD_BY", _sold(g)).edges.filter((F.col("kind") == "SOLD_BY") & (F.col("from_id") == PART)).select("id")
)
query("validate_nodes", "SELECT id, CASE WHEN kind = 'Supplier' THEN 'unknown node kind: Vendor' WHEN kind = 'Part' AND size > 25 THEN 'unknown property: colour|missing property: name' ELSE '' END AS errors FROM n WHERE kind IN ('Supplier', 'Part')")(
    lambda g: _broken(g).select("id", F.array_join(node_errors(g.schema), "|").alias("errors"))
)


def _broken(g: Graph) -> DataFrame:
    big = (F.col("kind") == "Part") & (property_text("size").cast("int") > 25)
    text = F.when(big, F.regexp_replace("properties", '"name"', '"colour"')).otherwise(F.col("properties"))
    return g.nodes.filter("kind IN ('Supplier', 'Part')").withColumns({"properties": text, "kind": F.when(F.col("kind") == "Supplier", "Vendor").otherwise(F.col("kind"))})


query("validate_edges", "SELECT id, CASE WHEN from_kind = 'Supplier' THEN 'invalid endpoints' ELSE '' END AS errors FROM e WHERE kind = 'IN_NATION'", False, True)(
    lambda g: g.edges.filter("kind = 'IN_NATION'").withColumn("to_kind", F.when(F.col("from_kind") == "Supplier", "Region").otherwise(F.col("to_kind"))).select("id", F.array_join(edge_errors(g.schema), "|").alias("errors"))
)
_DESC = [("node", k, p, str(d), d.required, "") for k, ps in SCHEMA.nodes.items() for p, d in ps.items()]
for _k, _e in SCHEMA.edges.items():
    _ends = ",".join(_e.sources) + "->" + ",".join(_e.targets)
    _DESC += [("edge", _k, p, str(d), d.required, _ends) for p, d in _e.props.items()] or [("edge", _k, None, None, None, _ends)]
query("schema_desc", f"SELECT * FROM (VALUES {', '.join(str(tuple(r)).replace('None', 'NULL') for r in _DESC)}) AS t(what, kind, property, type, required, ends)", False, False, "nothing AS (SELECT 1)")(lambda g: g.schema.describe(g.spark))


def _remote(g: Graph) -> Graph:
    """A copy with other ids, two more nations, and without suppliers."""
    move = lambda c: (F.col(c) + F.lit(500)).alias(c)
    nodes = g.nodes.filter("kind IN ('Region', 'Nation', 'Part')").select(move("id"), "kind", "properties", "created_at", "updated_at")
    new = nodes.filter("kind = 'Nation'").orderBy("id").limit(2).withColumns({"id": F.col("id") + 100, "properties": F.regexp_replace("properties", '"name":"', '"name":"New ')})
    edges = g.edges.filter("kind = 'IN_REGION'").withColumns({"from_id": F.col("from_id") + 500, "to_id": F.col("to_id") + 500})
    more = edges.orderBy("from_id").limit(2).withColumn("from_id", F.col("from_id") + 100)
    return Graph(g.schema, nodes.unionByName(new), edges.unionByName(more))


query("merge_nodes", "SELECT kind, count(*) + CASE WHEN kind = 'Nation' THEN 2 ELSE 0 END AS n FROM n GROUP BY 1")(lambda g: changes.merge(g, _remote(g)).kinds())
query("merge_edges", "SELECT kind, count(*) + CASE WHEN kind = 'IN_REGION' THEN 2 ELSE 0 END AS n FROM e GROUP BY 1", False, True)(lambda g: changes.merge(g, _remote(g)).edge_kinds())
query("merge_idmap", f"SELECT a.id + 500 AS remote_id, min(b.id) AS local_id FROM ({_KEYED}) a JOIN ({_KEYED}) b ON a.kind = b.kind AND a.nk = b.nk WHERE a.kind IN ('Region', 'Nation', 'Part') GROUP BY 1")(lambda g: changes.id_map(g, _remote(g)))


@query("merge_many", "SELECT count(*) AS n, count(DISTINCT id) AS ids, max(id) - (SELECT max(id) FROM n) AS last, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity, l_linenumber FROM lineitem)) AS edges, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity, l_linenumber FROM lineitem)) AS edge_ids FROM (SELECT (SELECT max(id) FROM n) + row_number() OVER () AS id FROM (SELECT DISTINCT o_orderkey FROM orders))")
def _merge_many(g: Graph) -> DataFrame:
    """All orders and what they hold come anew, to parts that are known by their keys."""
    anew = F.col("kind") == "Order"
    nodes = g.nodes.filter(F.col("kind").isin("Order", "Part")).withColumn("properties", F.when(anew, F.regexp_replace("properties", "^.", F.concat(F.lit('{"anew":'), F.col("id").cast("string"), F.lit(",")))).otherwise(F.col("properties")))
    remote = g.of(nodes=nodes.withColumn("id", F.col("id") + F.when(anew, 7).otherwise(0)), edges=g.edges.filter("kind = 'CONTAINS'").withColumn("from_id", F.col("from_id") + 7))
    fresh, edges = changes.merge_parts(g, remote)
    last = g.nodes.agg(F.max("id")).first()[0]
    numbers = edges.agg(F.count("*").alias("edges"), F.countDistinct("id").alias("edge_ids")).first()
    return fresh.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), (F.max("id") - last).alias("last"), *[F.lit(v).alias(k) for k, v in numbers.asDict().items()])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that each customer's orders hold, by customer: all walks of two hops at once."""
    return QUERIES["walk_batch"](spark, sf_dir)

