"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

# Rows up to this count, of a few short columns each, are a safe broadcast.
BROADCAST_ROWS = 200_000


def local_session(cpus: int | str = 8, app: str = "lodestone") -> SparkSession:
    """A local session for tests and benchmarks.  Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A new folder for one job's tables below the ``spark.checkpoint.dir`` that the cluster names.

    Executors must all see it.  Only a session whose driver is its one machine may go without the setting and gets a folder of
    its own; a cluster session is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, f"/tmp/spark-{uuid.uuid4().hex}")
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str | None = None) -> DataFrame:
    """Materialize ``df`` as parquet in the shared folder and read it back: survives executor loss, cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    return df.select(F.lit(1).alias("one")).limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a row-count check; beyond it the planner keeps its shuffle join."""
    return F.broadcast(df) if at_most(df, rows) else df
