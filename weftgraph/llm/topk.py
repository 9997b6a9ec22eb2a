"""Exact top-k inner products by pivot-table elimination."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shared_dir

_SAFE = 1 << 53


def _dots(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; exact: whether doubles hold all sums. Beyond that by Python's integers, held to the range of a long."""
    if exact:
        return (vectors @ query).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    wide = whole(vectors) @ whole(query)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in wide], np.int64)


class PivotSearch:
    """The k best of all candidates seen so far, for each of a block of queries.

    Distances from queries and candidates to pivots bound the distance of query and candidate from
    below, |d(q,p) - d(c,p)| at the best pivot, and so the inner product (|q|^2 + |c|^2 - d^2) / 2 from
    above. A batch's candidates are evaluated in order of that bound, until it is under the k-th score.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.queries, self.pivots, self.k = ids, queries, pivots, k
        self.norms = (queries**2).sum(1)
        self.table = self.distances(queries)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.evaluated = 0

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        squares = (vectors**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * (vectors @ self.pivots.T)
        return np.sqrt(np.maximum(squares, 0))

    def add(self, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray) -> None:
        norms = (vectors**2).sum(1)
        largest = max(float(norms.max(initial=0)), float(self.norms.max(initial=0)))
        exact, bounded = largest < _SAFE, largest < 1e300  # beyond, distances say nothing
        first = 8 * self.k
        for q in range(len(self.ids)):
            bound = np.abs(table - self.table[q]).max(1) if table.shape[1] else np.zeros(len(ids))
            upper = (norms + self.norms[q] - np.maximum(bound * (1 - 1e-9) - 1e-6 * np.sqrt(largest), 0) ** 2) / 2
            upper = upper + 1 + 1e-9 * largest if bounded else np.full(len(ids), np.inf)
            have_ids, have = self.best[q]
            open_ = np.flatnonzero(upper >= have[-1]) if len(have) == self.k else np.arange(len(ids))
            if not len(open_):
                continue
            order = open_[np.argsort(-upper[open_], kind="stable")]
            at, size = 0, first
            while at < len(order) and (len(have) < self.k or upper[order[at]] >= have[-1]):
                part = order[at : at + size]
                part, at, size = part[ids[part] != self.ids[q]], at + size, size * 4
                scores = _dots(vectors[part], self.queries[q], exact)
                self.evaluated += len(part)
                all_ids, all_scores = np.concatenate([have_ids, ids[part]]), np.concatenate([have, scores])
                keep = np.lexsort((all_ids, -all_scores))[: self.k]
                have_ids, have = all_ids[keep], all_scores[keep]
            self.best[q] = have_ids, have


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256, pivots: int = 16, block: int = 2048, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose key is divisible by `every`, the k rows with the highest
    inner product of floor(scale * x), among all rows of another key; ties go to the smaller key.

    Vectors that are null or hold a null, NaN or infinite component, and rows without a key, take no part. Shorter
    vectors count as filled up with zeros. Repeated rows are each a query and a candidate; with too few candidates a
    query has fewer rows, and an empty table gives none. Scores beyond a long are held to its range.

    The pivots are `pivots` rows taken by hash: a bounded number, like the `block` queries that a pass over the
    candidates searches for. The table of distances to the pivots is written once, with the vectors.
    """
    spark = embeddings.sparkSession
    fit = embeddings.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("x"))
    fit = fit.where("id is not null and x is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    spread = fit.select(F.struct(F.xxhash64("id").alias("h"), F.col("id"), F.col("x")).alias("s")).orderBy("s").limit(pivots).collect()
    if not spread:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = fit.agg(F.max(F.size("x"))).first()[0]

    def matrix(rows) -> np.ndarray:
        out = np.zeros((len(rows), width))
        for i, x in enumerate(rows):
            out[i, : len(x)] = x
        return out

    def scaled(rows) -> np.ndarray:  # here and not in SQL, whose floor() ends at 2^63
        return np.floor(matrix(rows) * scale)

    chosen = scaled([r.s.x for r in spread])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = PivotSearch(np.zeros(0, np.int64), np.zeros((0, width)), chosen, k)
        for b in batches:
            v = scaled(b.column("x").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(list(v)), pa.array(list(search.distances(v)))], names=["id", "x", "d"])

    table = saved(fit.mapInArrow(measure, "id long, x array<double>, d array<double>"), "pivots")
    asked = table.where(F.pmod("id", F.lit(every)) == 0)
    n_blocks = -(-asked.count() // block)
    if n_blocks == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = saved(asked.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")), "queries")

    path = f"{shared_dir(spark)}/weft/found-{uuid.uuid4().hex}"
    for i in range(n_blocks):
        rows = sorted((r.id, tuple(r.x)) for r in asked.where(F.col("block") == i).collect())
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), matrix([r[1] for r in rows])))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, queries = sent.value
            state = PivotSearch(ids, queries, chosen, k)
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    n = part.num_rows
                    vectors = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, width) if width else np.zeros((n, 0))
                    distances = part.column("d").flatten().to_numpy(zero_copy_only=False).reshape(n, len(chosen))
                    state.add(part.column("id").to_numpy(), vectors, distances)
            q = np.repeat(np.arange(len(ids)), [len(x[0]) for x in state.best]).astype(np.int32)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[q]), pa.array(np.concatenate([x[0] for x in state.best])), pa.array(np.concatenate([x[1] for x in state.best]))], names=["q", "query_id", "vec_id", "score"])

        part = table.mapInArrow(search, "q int, query_id long, vec_id long, score long")
        w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        part.write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)
