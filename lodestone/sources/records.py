"""Readers and writers of record files: JSON lines with a metadata header, sessions, purchases, results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = "usage struct<prompt_tokens:bigint,completion_tokens:bigint>"
EXTRACTION_SCHEMA = (
    "record_type string, experiment string, parent_asin string, seq bigint, status string, "
    "attributes map<string,array<struct<name:string,value:string,evidence:string>>>, "
    "rejected_attributes array<struct<field:string,index:int,reason:string,entry:struct<name:string,value:string,evidence:string>>>, "
    f"raw_response string, {USAGE}")
SESSION_SCHEMA = (
    "sample_id string, scenario_type string, category_bucket string, difficulty_bucket string, "
    "ground_truth struct<parent_asin:string>, user_profile struct<purchase_frequency:string,average_prior_rating:double,"
    "rating_style:string,preference_tags:array<string>,summary:string>")


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_extraction(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(settings from the metadata header, records); a file without header is an error."""
    rows = read_json_lines(spark, path, EXTRACTION_SCHEMA)
    header = rows.filter("record_type = 'metadata'").select("experiment").limit(1).collect()
    if not header:
        raise ValueError(f"no metadata header in {path}")
    records = rows.filter("record_type is null or record_type <> 'metadata'").drop("record_type", "experiment")
    return json.loads(header[0]["experiment"] or "{}"), records


def read_public_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(excluded products, profile templates) of a session file; one without profiles is an error."""
    rows = read_json_lines(spark, path, SESSION_SCHEMA)
    excluded = rows.select("ground_truth.parent_asin").distinct()
    templates = rows.select("sample_id", F.col("user_profile.preference_tags").alias("preference_tags")).filter("preference_tags is not null")
    if templates.isEmpty():
        raise ValueError("the session file holds no profile")
    return excluded, templates


def read_purchases(spark: SparkSession, path: str) -> DataFrame:
    """Purchase CSV with a header; parent_asin, rating and history are required."""
    rows = spark.read.option("header", True).csv(path)
    missing = {"parent_asin", "rating", "history"} - set(rows.columns)
    if missing:
        raise ValueError(f"purchase file lacks the columns {sorted(missing)}")
    return rows.withColumn("rating", F.col("rating").cast("double"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with keys in alphabetical order; an existing result is never overwritten."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_stream(df: DataFrame, path: str, checkpoint: str):
    """Streaming append of records, exactly once through the checkpoint."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def publish(df: DataFrame, path: str) -> None:
    """Publish a finished table: refused when something is there, visible only once the job has committed."""
    df.write.mode("errorifexists").parquet(path)
