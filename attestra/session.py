"""Session settings and table access."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = "*", app: str = "attestra", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; conf has further settings, with _ for dots."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config(map={k.replace("_", "."): v for k, v in conf.items()})
        .getOrCreate()
    )


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed; a shared or copied folder has to hold it."""
    found = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in found.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, found) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of this machine is used
    if the master is local, and RuntimeError raised otherwise."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file:///tmp/checkpoints/attestra")
        found = context.getCheckpointDir()
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the application's part of the shared folder and read back, so that later steps neither repeat nor
    plan the work before it, and no executor holds the only copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestra-{spark.sparkContext.applicationId}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
