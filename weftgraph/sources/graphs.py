"""Graph sources: raw files to (nodes, edges, masks), in the schemas below."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.FloatType()))])
EDGES = T.StructType([T.StructField("src", T.LongType(), False), T.StructField("dst", T.LongType(), False)])


def edges_csv(spark: SparkSession, path: str | list[str], header: bool = False, partitions: int | None = None) -> DataFrame:
    """src, dst of each line, by position. gzip can't be split, so `partitions` deals the rows out again."""
    df = spark.read.csv(path, schema="src long, dst long", header=header)
    return df.repartition(partitions) if partitions else df


def targets_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of a file with a header."""
    return spark.read.csv(path, header=True, schema="id long, target double").select("id", F.col("target").cast("int").alias("label"))


def split_csv(spark: SparkSession, train: str, valid: str, test: str) -> DataFrame:
    """(id, split) of three files of ids without a header."""
    parts = [spark.read.csv(p, schema="id long").withColumn("split", F.lit(s)) for p, s in ((train, "train"), (valid, "valid"), (test, "test"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def item_sets_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, item) of one JSON object {id: [items]}."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<long>>").alias("m"))
    return doc.select(F.explode("m").alias("id", "items")).select(F.col("id").cast("long").alias("id"), F.explode("items").alias("item"))


def multi_hot(items: DataFrame, width: int = 128) -> DataFrame:
    """(id, features): one float for each of the `width` most frequent items, ties to the smaller item."""
    top = items.distinct().groupBy("item").count().orderBy(F.desc("count"), "item").limit(width)
    vocabulary = top.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "item"))), lambda s: s["item"]).alias("vocabulary"))
    sets = items.groupBy("id").agg(F.collect_set("item").alias("items"))
    return sets.crossJoin(F.broadcast(vocabulary)).select("id", F.transform("vocabulary", lambda v: F.array_contains("items", v).cast("float")).alias("features"))


def numpy_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """node_feat, edge_index and node_label of an .npz file, under these names or with dashes; read by Spark's readers."""
    import io

    content = spark.read.format("binaryFile").load(path).first()["content"]
    data = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
    return {k.replace("-", "_"): data[k] for k in data.files if k.replace("-", "_") in ("node_feat", "edge_index", "node_label")}


def npy_rows(spark: SparkSession, path: str, per_task: int = 1 << 16) -> DataFrame:
    """(row, x array<double>) of an .npy file of one or two dimensions, C order. Tasks read ranges of its rows, of which none
    holds the file; the path is one that pyarrow's file systems reach from every executor (a plain path, file, s3, gs, hdfs)."""
    system, at = _file(path)
    with system.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        start = f.tell()
    if fortran and len(shape) > 1 or len(shape) not in (1, 2) or dtype.hasobject:
        raise ValueError("an array of numbers, of one or two dimensions in C order")
    width = shape[1] if len(shape) == 2 else 1

    def run(batches):
        system, at = _file(path)
        with system.open_input_file(at) as f:
            for b in batches:
                for first in b.column(0).to_pylist():
                    n = min(per_task, shape[0] - first)
                    raw = f.read_at(n * width * dtype.itemsize, start + first * width * dtype.itemsize)
                    x = np.frombuffer(raw, dtype, n * width).astype(float)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), lists], names=["row", "x"])

    tasks = max(1, -(-shape[0] // per_task))
    return spark.range(0, shape[0], per_task, min(tasks, 10_000)).mapInArrow(run, "row long, x array<double>")


def _file(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def npy_graph(spark: SparkSession, edge_index: str, features: str | None = None, labels: str | None = None, width: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of .npy files, read by ranges: edge_index has a row for each edge, source and target. Without
    features, all ones of `width`; without labels, zeros; NaN labels are -1. Without features, nodes are the edges' ends."""
    pairs = npy_rows(spark, edge_index)
    edges = pairs.select(F.col("x")[0].cast("long").alias("src"), F.col("x")[1].cast("long").alias("dst"))
    if features:
        nodes = npy_rows(spark, features).select(F.col("row").alias("id"), F.transform("x", lambda v: v.cast("float")).alias("features"))
    else:
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("features", F.array_repeat(F.lit(1.0).cast("float"), width))
    if labels:
        y = npy_rows(spark, labels).select(F.col("row").alias("id"), F.coalesce(F.nanvl(F.col("x")[0], F.lit(None).cast("double")).cast("int"), F.lit(-1)).alias("label"))
        return nodes.join(y, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"), "features"), edges
    return nodes.select("id", F.lit(0).alias("label"), "features"), edges


def from_arrays(spark: SparkSession, edge_index: np.ndarray, n: int | None = None, features: np.ndarray | None = None, labels: np.ndarray | None = None, width: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of arrays on the driver. Without features, all ones of `width`; without labels, zeros; NaN labels are -1."""
    n = n if n is not None else int(edge_index.max(initial=-1)) + 1 if features is None else len(features)
    labels = np.zeros(n) if labels is None else np.asarray(labels, float).reshape(-1)
    features = np.ones((n, width), np.float32) if features is None else np.asarray(features, np.float32)
    nodes = [(i, -1 if np.isnan(y) else int(y), [float(x) for x in row]) for i, (y, row) in enumerate(zip(labels, features, strict=True))]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame([(int(a), int(b)) for a, b in zip(*edge_index, strict=True)], EDGES)


def fill_features(nodes: DataFrame, width: int) -> DataFrame:
    """Missing features are ones, missing labels 0."""
    ones = F.array_repeat(F.lit(1.0).cast("float"), width)
    return nodes.withColumns({"features": F.coalesce("features", ones), "label": F.coalesce("label", F.lit(0))})


def one_relation(triples: DataFrame, relation: str, column: str = "rel") -> DataFrame:
    """The (src, dst) of one type of edge in a heterogeneous graph."""
    return triples.where(F.col(column) == relation).select("src", "dst")


def rows(spark: SparkSession, data: Sequence, schema: T.StructType | str) -> DataFrame:
    """A frame of rows on the driver under an explicit schema."""
    return spark.createDataFrame(data, schema)
