"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import running_sum, saved


def tree(n_shards: int, shards_per_rack: int = 4, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> dict:
    """{region: {rack: {shard: weight}}} with shards dealt to racks and racks to regions in order of their number."""
    out: dict = {}
    for shard in range(n_shards):
        rack = shard // shards_per_rack
        out.setdefault(rack // racks_per_region, {}).setdefault(rack, {})[shard] = float((weights or {}).get(shard, 1.0))
    return out


def _total(node: dict | float) -> float:
    return sum(map(_total, node.values())) if isinstance(node, dict) else node


def _draw(key: Column, level: int, child: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(child)), 12)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(weight)


def _descend(key: Column, node: dict, level: int = 0) -> Column:
    """Of each child, -ln(u) / weight with u drawn from the hash of key, level and child; the smallest draw wins."""
    draws = []
    for child, below in sorted(node.items()):
        if (weight := _total(below)) > 0:
            draws.append(F.struct(_draw(key, level, child, weight).alias("draw"), F.lit(child).alias("child")))
    if not draws:
        raise ValueError("a tree needs a shard of positive weight")
    won = (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0]).getField("child")
    if not isinstance(next(iter(node.values())), dict):
        return won
    out = None
    for child, below in sorted(node.items()):
        if _total(below) > 0:
            then = _descend(key, below, level + 1)
            out = F.when(won == child, then) if out is None else out.when(won == child, then)
    return out


def shard_of(key: Column, shards: dict) -> Column:
    """The shard of `key` in a tree of weights: one draw at each of the levels region, rack and shard.

    A level's draws depend on key, level, child and the child's total weight alone. So a change of a
    shard's weight moves rows only into or out of the subtrees that hold it; a new region that holds
    one new shard takes rows only into that shard. A null key has a shard of its own, like any key.
    """
    return _descend(key, shards).cast("int")


def filled_shard_of(key: Column, n_shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> Column:
    """The shard of `key` among n_shards in a tree of regions that all have the same number of places, of which the last ones
    may be vacant. Each region draws by its places, and in it rack and place are drawn as in shard_of(); of the regions whose place is
    filled the smallest draw wins. Where none is, all shards draw. Filling one more place, in an old region or a new one, therefore
    moves rows only into that shard, whatever the number of shards; a shard of a region with vacant places gets fewer rows than others."""
    per_region = shards_per_rack * racks_per_region
    regions = tree(-(-n_shards // per_region) * per_region, shards_per_rack, racks_per_region)
    drawn = [F.struct(_draw(key, 0, r, _total(below)).alias("draw"), _descend(key, below, 1).alias("shard")) for r, below in sorted(regions.items())]
    hit = F.array_min(F.filter(F.array(*drawn), lambda x: x["shard"] < n_shards))["shard"]
    alone = F.array_min(F.array(*[F.struct(_draw(key, 3, i, 1.0).alias("draw"), F.lit(i).alias("shard")) for i in range(n_shards)]))["shard"]
    return F.coalesce(hit, alone).cast("int")


def hash_tree_shards(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", text: str = "text", rows_per_bucket: int = 1024) -> DataFrame:
    """Deal documents to shards: (key, size, text_crc32, law, shard, slot, grown_shard).

    size: UTF-8 bytes of the text plus 1 (null: 1). law: `key`, since key and number of shards alone
    decide, by filled_shard_of(). slot: place in the shard from 0 without gaps, by hash bucket, key, checksum and size;
    rows that agree in all of these take any order among themselves. grown_shard: the shard among n_shards + 1.
    Null keys, empty texts and repeated rows are dealt like others; an empty table gives no rows.
    No task holds a whole shard: places are counted by hash buckets of about rows_per_bucket rows, and rows that agree in all are
    one row with a count until the end, where they are dealt out by rows_per_bucket.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    row = docs.select(
        F.col(key),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        filled_shard_of(F.col(key), n_shards).alias("shard"),
        filled_shard_of(F.col(key), n_shards + 1).alias("grown_shard"),
    )
    slim = saved(row.groupBy(*row.columns).agg(F.count("*").alias("_n")), "shards")
    buckets = max(1, -(-slim.count() // (n_shards * rows_per_bucket)))
    slim = slim.withColumn("_bucket", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(buckets)))
    out = running_sum(slim, ["shard"], "_bucket", [F.col(key), F.col("text_crc32"), F.col("size")], "_n", "_first")
    columns = [key, "size", "text_crc32", F.lit("key").alias("law"), "shard"]
    few = out.where("_n <= " + str(rows_per_bucket)).select(*columns, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1)).alias("slot"), "grown_shard")
    parts = out.where("_n > " + str(rows_per_bucket)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(rows_per_bucket).cast("long"))).alias("_at")).repartition("_first", "_at", "shard")
    many = parts.select(*columns, F.explode(F.sequence(F.col("_first") + F.col("_at"), F.col("_first") + F.least(F.col("_at") + rows_per_bucket, F.col("_n")) - 1)).alias("slot"), "grown_shard")
    return few.unionByName(many)
