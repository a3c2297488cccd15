"""A graph over business tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..schema import SPARK_TYPES, Schema

#: Ids of a kind start at its number times this.
STEP = 10**12
SCHEMA = Schema.parse("""
[nodes.Region]
name = "string"
[nodes.Nation]
name = "string"
[nodes.Customer]
name = "string"
acctbal = "float"
mktsegment = "string?"
[nodes.Supplier]
name = "string"
acctbal = "float"
[nodes.Part]
brand = "string"
name = "string"
ptype = "string"
size = "int"
[nodes.Order]
status = "enum:O,F,P"
totalprice = "float"
orderdate = "timestamp"
priority = "string?"
[nodes.Document]
lang = "string?"
source = "string?"
n_chars = "int?"
[nodes.Conversation]
first_prompt = "string?"
turns = "int"
[nodes.User]
name = "string"
[edges.IN_REGION]
from = "Nation"
to = "Region"
[edges.IN_NATION]
from = ["Customer", "Supplier"]
to = "Nation"
[edges.PLACED]
from = "Customer"
to = "Order"
[edges.CONTAINS]
from = "Order"
to = "Part"
quantity = "float?"
linenumber = "int?"
[edges.SOLD_BY]
from = "Part"
to = "Supplier"
quantity = "float?"
linenumber = "int?"
[natural_keys]
Region = ["name"]
Nation = ["name"]
Customer = ["name"]
Supplier = ["name"]
Part = ["name", "brand", "ptype", "size"]
User = ["name"]
""")
NUMBER = {k: i for i, k in enumerate(("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Document", "Conversation", "User"), 1)}


def node_id(kind: str, key: int) -> int:
    return NUMBER[kind] * STEP + key


def _nodes(df: DataFrame, kind: str, key: str, **props: Column) -> DataFrame:
    """A table as nodes with typed property columns: what ``Graph.table`` promises."""
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    text = {k: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if SCHEMA.nodes[kind][k].type == "timestamp" else c for k, c in props.items()}
    packed = F.to_json(F.struct(*[c.alias(k) for k, c in sorted(text.items())]))
    own = [props[k].cast(SPARK_TYPES[p.type]).alias(k) for k, p in SCHEMA.nodes[kind].items()]
    return df.select((F.lit(NUMBER[kind] * STEP) + F.col(key).cast("long")).alias("id"), *own, packed.alias("properties"), start.alias("created_at"), start.alias("updated_at"))


def _edges(df: DataFrame, number: int, kind: str, a: tuple[str, str], b: tuple[str, str], own: Column, **props: Column) -> DataFrame:
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    packed = F.to_json(F.struct(*[c.alias(k) for k, c in sorted(props.items())])) if props else F.lit("{}")
    end = lambda e: F.lit(NUMBER[e[0]] * STEP) + F.col(e[1]).cast("long")
    return df.select((F.lit(number * STEP) + own).alias("id"), F.lit(kind).alias("kind"), end(a).alias("from_id"), end(b).alias("to_id"), F.lit(a[0]).alias("from_kind"), F.lit(b[0]).alias("to_kind"), packed.alias("properties"), start.alias("created_at"))


def graph_from_tables(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes and edges as a union of scans: a filter on kind leaves only the tables that hold it, and filters on the
    properties of one kind are filters on its table's columns."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c = F.col
    line = c("l_orderkey").cast("long") * 8 + c("l_linenumber")
    first = F.min_by(F.when(c("role") == "user", c("text")), F.when(c("role") == "user", c("turn")))
    talks = t("conversations").groupBy("conv_id").agg(first.alias("first_prompt"), F.count("*").alias("turns"))
    tables = {
        "Region": _nodes(t("region"), "Region", "r_regionkey", name=c("r_name")),
        "Nation": _nodes(t("nation"), "Nation", "n_nationkey", name=c("n_name")),
        "Customer": _nodes(t("customer"), "Customer", "c_custkey", name=c("c_name"), acctbal=c("c_acctbal"), mktsegment=c("c_mktsegment")),
        "Supplier": _nodes(t("supplier"), "Supplier", "s_suppkey", name=c("s_name"), acctbal=c("s_acctbal")),
        "Part": _nodes(t("part"), "Part", "p_partkey", name=c("p_name"), brand=c("p_brand"), ptype=c("p_type"), size=c("p_size")),
        "Order": _nodes(t("orders"), "Order", "o_orderkey", status=c("o_orderstatus"), totalprice=c("o_totalprice"), orderdate=c("o_orderdate"), priority=c("o_orderpriority")),
        "Document": _nodes(t("documents"), "Document", "doc_id", lang=c("lang"), source=c("source"), n_chars=c("n_chars")),
        "Conversation": _nodes(talks, "Conversation", "conv_id", first_prompt=c("first_prompt"), turns=c("turns")),
        "User": _nodes(t("events").select("user_id").distinct(), "User", "user_id", name=F.concat(F.lit("user-"), c("user_id").cast("string"))),
    }
    edges = [
        _edges(t("nation"), 1, "IN_REGION", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), c("n_nationkey").cast("long")),
        _edges(t("customer"), 2, "IN_NATION", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), c("c_custkey").cast("long")),
        _edges(t("supplier"), 3, "IN_NATION", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), c("s_suppkey").cast("long")),
        _edges(t("orders"), 4, "PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey"), c("o_orderkey").cast("long")),
        _edges(t("lineitem"), 5, "CONTAINS", ("Order", "l_orderkey"), ("Part", "l_partkey"), line, quantity=c("l_quantity"), linenumber=c("l_linenumber")),
        _edges(t("lineitem"), 6, "SOLD_BY", ("Part", "l_partkey"), ("Supplier", "l_suppkey"), line, quantity=c("l_quantity"), linenumber=c("l_linenumber")),
    ]
    nodes = [df.select("id", F.lit(k).alias("kind"), "properties", "created_at", "updated_at") for k, df in tables.items()]
    join = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return Graph(SCHEMA, join(nodes), join(edges), tables, {k: (NUMBER[k] * STEP, NUMBER[k] * STEP + STEP - 1) for k in tables})
