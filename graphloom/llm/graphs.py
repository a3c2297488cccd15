"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node that edges (long, in any direction) reach from each node of ``edges``.

    Each round hooks every node to the smallest node beside it, if that is smaller, follows the hooks to their roots by
    jumping (twice as far each time), and draws the edges between roots anew, until none is left. A root that stays
    after two rounds has taken in another node in the first, or it would lie beside a smaller root after it. So nodes
    with edges at least halve every two rounds: n nodes need at most 2 log2(n) rounds of log2(n) jumps, without a cap.
    Tables are written to the shared folder each round. Null ends and loops are left out.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("beside"))
    both = both.filter("node IS NOT NULL AND beside IS NOT NULL AND node != beside")
    both = settle(both.unionByName(both.select(F.col("beside").alias("node"), F.col("node").alias("beside"))).distinct(), "edges")
    labels = None
    while True:
        hooks = settle(both.groupBy("node").agg(F.least(F.min("beside"), F.first("node")).alias("root")), "hooks")
        while True:
            beyond = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            following = settle(hooks.join(beyond, "root").select("node", F.col("root").alias("was"), F.col("further").alias("root")), "hooks")
            hooks = following.select("node", "root")
            if following.filter("root != was").isEmpty():
                break
        if labels is None:
            labels = hooks.withColumnRenamed("root", "label")
        else:
            labels = settle(labels.join(hooks.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        ends = hooks.select(F.col("node").alias("beside"), F.col("root").alias("beside_root"))
        both = both.join(hooks, "node").join(ends, "beside").filter("root != beside_root")
        both = settle(both.select(F.col("root").alias("node"), F.col("beside_root").alias("beside")).distinct(), "edges")
        forget(spark)
        if both.isEmpty():
            return labels
