"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running_sum, saved

#: A schedule gives a source's weight over training time as knots (time, weight), linear between them.
#: They repeat over the sources in order: even, rising threefold, falling threefold.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (((0, 1), (1, 1)), ((0, 1), (1, 3)), ((0, 3), (1, 1)))


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    """The schedule's integral: for each piece its start, weight there, slope, and the demand before it as a part of 1."""
    if [t for t, _ in knots] != sorted({t for t, _ in knots}) or knots[0][0] != 0 or knots[-1][0] != 1 or min(w for _, w in knots) < 0:
        raise ValueError("a schedule's knots run from time 0 to 1 with weights of 0 or more")
    pieces = [(t0, w0, (w1 - w0) / (t1 - t0), (w0 + w1) * (t1 - t0) / 2) for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False)]
    whole = sum(p[3] for p in pieces)
    out, done = [], 0.0
    for t0, w0, slope, area in pieces:
        if area > 0:
            out.append(F.struct(F.lit(float(t0)).alias("t"), F.lit(w0 / whole).alias("w"), F.lit(slope / whole).alias("slope"), F.lit(done).alias("demand")))
            done += area / whole
    return F.array(*out)


def _invert(demand: Column, segments: Column) -> Column:
    """The time by which a source's cumulative demand reaches `demand`, a part of 1."""
    s = F.element_at(F.filter(segments, lambda x: (x["demand"] <= demand) | (x["demand"] == 0)), -1)
    left = demand - s["demand"]
    root = s["w"] + F.sqrt(F.greatest(s["w"] * s["w"] + 2 * s["slope"] * left, F.lit(0.0)))
    return F.when(left <= 0, s["t"]).otherwise(F.least(s["t"] + 2 * left / root, F.lit(1.0)))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """(source, source_size) -> also source_no, weight, target. Sources by code point, null last, take the
    weights in turn and share the sum of all sizes; a target stops at `epochs` times its source's size,
    and what is over is shared again by weight. One row per source passes through one task."""
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")).withColumn("weight", w)
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    # In order of size by weight, a source stops at its cap if an even share of what the ones before leave reaches it.
    ranked = ranked.withColumns({
        "_left": F.sum("source_size").over(everything) - epochs * F.coalesce(F.sum("source_size").over(filled), F.lit(0)),
        "_weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0)),
    })
    ranked = ranked.withColumn("_full", F.col("_left") * F.col("weight") >= epochs * F.col("source_size") * F.col("_weights"))
    first = F.min(F.when(~F.col("_full"), F.struct(F.col("source_size") / F.col("weight"), "source_no", "_left", "_weights"))).over(everything)
    level = ranked.withColumns({"_left": first["_left"], "_weights": first["_weights"]})
    target = F.when(F.col("_full"), (epochs * F.col("source_size")).cast("double")).otherwise(F.col("_left") * F.col("weight") / F.col("_weights"))
    return level.select("source", "source_size", "source_no", "weight", target.alias("target"))


def curriculum_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), schedules=SCHEDULES, epochs: int = 3, text: str = "text", key: str = "doc_id", source: str = "source", rows_per_bucket: int = 1024, carry: bool = False) -> DataFrame:
    """Plan the mix: a row per document, sorted by training position over all partitions, with key,
    source, size, source_size, target, taken, position and copies (epoch, words, position).

    size: words of the text (null: 0). Each source's documents stand in order of the MD5 of their key;
    this order, passed through up to `epochs` times, is cut off at the target (rounded): so a source's
    taken words are its target, and the one document at the cut is taken in part. The source's weight
    schedule is integrated to its cumulative demand, and a copy's position is the time, 0 to 1, at
    which that demand reaches the words before the copy. Documents not taken have no position and
    stand last. Null sources are a source, null keys keep a place of their own, repeated rows share
    theirs, documents without words take none; an empty table gives no rows. The result depends on
    the rows alone, so reruns agree. carry: unsorted, with a column `_row` of the document's own columns.
    """
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), 0)).cast("long")
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.struct(*docs.columns).alias("_row"))
    slim = saved(sized.drop("_row"), "sizes")
    targets = saved(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "targets")
    buckets = max(1, -(-slim.count() // rows_per_bucket))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    bucket = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32))
    placed = (sized if carry else slim).withColumn("_order", order).withColumn("_bucket", bucket)
    named = targets.withColumnRenamed("source", "_source")
    placed = placed.join(named, placed["source"].eqNullSafe(named["_source"])).drop("_source")
    placed = running_sum(placed, ["source_no"], "_bucket", [F.col("_order"), F.col("doc_id"), F.col("size")], "size", "_before")

    quota = F.floor(F.col("target") + 0.5)
    segments = F.element_at(F.array(*[_segments(k) for k in schedules]), ((F.col("source_no") - 1) % len(schedules) + 1).cast("int"))
    copies = []
    for epoch in range(epochs):
        before = F.col("_before") + epoch * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), quota - before))
        copies.append(F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), _invert(before / F.col("target"), segments).alias("position")))
    taken = placed.withColumn("copies", F.filter(F.array(*copies), lambda c: c["words"] > 0))
    taken = taken.withColumns({"taken": F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]), "position": F.get("copies", F.lit(0))["position"]})
    out = taken.select(F.col("doc_id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "taken", "position", "copies", "_order", *["_row"] * carry)
    return out if carry else _sorted(out).drop("_order")


def _sorted(mix: DataFrame) -> DataFrame:
    """Sorted by position over all partitions."""
    place = [F.col("position").asc_nulls_last(), F.col("_order")]
    return mix.repartitionByRange(*place).sortWithinPartitions(*place)


def training_order(docs: DataFrame, **parameters) -> DataFrame:
    """The documents in training order, with their own columns: a row for each copy that curriculum_mix() takes, at its
    position. The copy at a source's cut stays whole if at least half of it is taken, and goes if less is."""
    mix = curriculum_mix(docs, carry=True, **parameters)
    copies = mix.select("_row", "_order", "size", F.explode("copies").alias("c")).where(F.col("c.words") * 2 >= F.col("size"))
    return _sorted(copies.select("_row", "_order", F.col("c.position").alias("position"))).select("_row.*")
