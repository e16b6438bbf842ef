"""Helpers that several training-data operators share: scratch tables, ASCII folding and link components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI.

    It is spark.checkpoint.dir. Where that is unset, a folder of this machine is used if the master is local, and
    RuntimeError raised otherwise.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file:///tmp/checkpoints/attestra-{uuid.uuid4().hex}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
        found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", full).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's own folder, which can go as a whole when its results have been used."""
    return f"{shared_dir(spark)}/attestra-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and no executor holds the only copy."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


#: Rows of a driver-made table up to which every task gets a copy; a longer one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def dictionary(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of rows that the driver holds, marked for broadcast if it has at most BROADCAST_ROWS."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of an undirected graph, as (id, component_id).

    edges has long columns src and dst; loops, repeats and either direction are allowed, and rows with a
    null end are ignored. A node without edges does not occur in the result. Alternating large-star and
    small-star steps (Kiveris et al. 2014) need a logarithmic number of rounds, each of which moves every
    edge a constant number of times. The minimum of a hub's neighbours is pre-aggregated before the shuffle
    and joined back, so a hub is never gathered in one task. Each round is written to the shared folder.
    """
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src <> dst")
    e = e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stored(e, "edges")
    digest = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, e = e, stored(small.distinct(), "edges")
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == digest:
            break
        digest = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
