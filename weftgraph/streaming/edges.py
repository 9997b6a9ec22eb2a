"""Edges as a stream: degrees kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """(src, dst) of the Parquet files that arrive in a folder."""
    return spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", per_trigger).parquet(folder)


def degree_stream(edges: DataFrame) -> DataFrame:
    """(id, degree) of an append-only stream of simple edges, each in one direction; for output mode complete or update."""
    ends = edges.where("src != dst").select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))
