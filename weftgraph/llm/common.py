"""Helpers that the operators share: tables in the shared folder, word patterns, joins on crowded keys, distributed running sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.models import trim
from weftgraph.operators.storage import discard, saved, shared_dir  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`run`, after which the worker gives the memory that it has no more use for back to the system: it waits for the next task beside the JVM."""

    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        trim()

    return tidied


def even_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = 1000, least: int = 1000) -> DataFrame:
    """left joined with right, which has one row a key at most, where a key may hold any share of left's rows. Keys with over
    1 / `most` of them, and over `least`, are fewer than `most`, so right's rows of these are sent whole; of the rest none is crowded. left is
    read more than once: a table."""
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") > max(left.count() // most, least)).select(key).toArrow()
    if not hot.num_rows:
        out = left.where(F.col(key).isNotNull()).join(right, key, how)
    else:
        hot = F.broadcast(left.sparkSession.createDataFrame(hot, counts.select(key).schema))
        crowded = left.join(hot, key, "left_semi").join(F.broadcast(right.join(hot, key, "left_semi")), key, how)
        out = crowded.unionByName(left.where(F.col(key).isNotNull()).join(hot, key, "left_anti").join(right, key, how))
    if how == "left":  # rows without a key find none
        out = out.unionByName(left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c != key]))
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same group that stand before, in order of (bucket, *order).

    No task holds a whole group: sums per (group, bucket) are added up over the few bucket rows, and
    rows are ordered within their bucket only. The group columns and the bucket must not be null.
    """
    keys = [*group, bucket]
    parts = df.groupBy(*keys).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    starts = parts.select(*keys, (F.sum("_part").over(before) - F.col("_part")).alias("_start"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(starts, keys).withColumn(out, F.col("_start") + F.sum(value).over(inner) - F.col(value)).drop("_start")
