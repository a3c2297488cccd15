"""Tables in the folder that driver and executors share: they end lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder, removed at exit, only where none is set and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/") if ":" in found else "file://" + os.path.abspath(found)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder, new on each call."""
    return f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, what: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    path = scratch(df.sparkSession, what)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_PLACE = (1 << 33) - 1


def numbered(rows: DataFrame, after: int, *order: str, name: str = "id") -> DataFrame:
    """``rows`` with a column ``name`` of numbers ``after`` + 1 on, gapless and in ``order`` (ties in any order).

    Rows are ranged and sorted within ranges, and written so with their range and place, as a second run of the same
    plan may cut its ranges elsewhere. A number is then how many rows the ranges before have, plus the place: no task
    sorts more than a range, and one number for each range comes to the driver."""
    spread = rows.drop(name).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    spread = settle(spread, "numbered")
    part = F.shiftrightunsigned("__at", 33).cast("int")
    starts, total = [], after
    for r in spread.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts.append((r["p"], total))
        total += r["n"]
    if not starts:
        return spread.withColumn(name, F.lit(None).cast("bigint")).drop("__at")
    at = rows.sparkSession.createDataFrame(starts, "__p int, __start bigint")
    placed = spread.withColumn("__p", part).join(F.broadcast(at), "__p")
    return placed.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit(_PLACE)) + 1).drop("__at", "__p", "__start")


def hadoop(spark: SparkSession, uri: str):
    """(file system, path) by Spark's own means, so that any store that it reads works."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application settled; results that still read them must be written before."""
    fs, path = hadoop(spark, f"{shared_dir(spark)}/graphloom-{spark.sparkContext.applicationId}")
    fs.delete(path, True)
