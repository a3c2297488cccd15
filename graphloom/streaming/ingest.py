"""Streams of node rows into a graph's folder, each natural key once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import settle
from ..operators.changes import natural_key, new_nodes
from ..operators.graph import Graph
from ..schema import Schema, node_errors
from ..sources.snapshots import Store


def ingest(stream: DataFrame, schema: Schema, prefix: str, rejected: str, checkpoint: str):
    """Add rows (kind, properties) of a stream to the graph in ``prefix`` (``Store``), the first of each natural key;
    later ones, and those of a batch that runs again after a failure, are there already and add nothing. Rows that the
    schema does not allow go to the folder ``rejected`` with their errors and the number of their batch, which a batch
    that runs again replaces. A batch reads the keys of the kinds that it brings and writes only what it adds. Returns
    the streaming query."""

    def add(batch: DataFrame, number: int) -> None:
        checked = settle(batch.select("kind", F.coalesce("properties", F.lit("{}")).alias("properties")).withColumn("errors", node_errors(schema)), "ingest")
        checked.filter(F.size("errors") > 0).write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/batch={number}")
        good = checked.filter(F.size("errors") == 0).select("kind", "properties", natural_key(schema).alias("nk"))
        good = good.groupBy("kind", "nk").agg(F.min("properties").alias("properties"))
        kinds = [r["kind"] for r in good.select("kind").distinct().limit(len(schema.nodes)).collect()]

        def fresh(g: Graph):
            known = g.nodes.filter(F.col("kind").isin(kinds)).select("kind", natural_key(schema).alias("nk"))
            rows = settle(good.join(known, ["kind", "nk"], "left_anti"), "ingest-new")
            return (None, None) if rows.isEmpty() else (new_nodes(g, rows), None)

        if kinds:
            Store(batch.sparkSession, prefix, schema).change(fresh)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
