"""Column functions of the graph engine: vectors, labels, hashes that SQL shares, size buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reserved ids: the bucket of all small communities, and where super-node ids begin.
MISC, SUPER_BASE = -1, -1000
#: Sizes from which a community is large or medium in a report, by rows of its training frame.
LARGE_OVER, MEDIUM_FROM = 200, 50


def super_id(community: Column) -> Column:
    """The id of a community's super-node; apart from node ids (0 or more) and MISC for communities of 0 or more."""
    return F.lit(SUPER_BASE).cast("long") - community


def label_or_missing(label: Column) -> Column:
    """Null and NaN labels are -1."""
    return F.coalesce(F.nanvl(label.cast("double"), F.lit(None).cast("double")).cast("int"), F.lit(-1))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def hadamard(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(hadamard(a, b), F.lit(0.0), lambda s, x: s + x)


def size_bucket(n: Column) -> Column:
    return F.when(n > LARGE_OVER, "large").when(n >= MEDIUM_FROM, "medium").otherwise("small")


def spread(seed: int, *ids: Column) -> Column:
    """A whole number from 0 to 2**32 - 1 for ids and seed, by arithmetic that any SQL engine can repeat."""
    out = F.lit(seed).cast("long") % (1 << 31)
    for i in ids:
        out = F.pmod(F.pmod(i.cast("long"), F.lit(1 << 31)) * 2654435 + out * 40503 + 12345, F.lit(1 << 32))
    return F.pmod(F.pmod(out, F.lit(1 << 31)) * 1597334 + F.floor(out / 65536) * 2654435, F.lit(1 << 32))


def spread_of(seed: int, *ids: np.ndarray) -> np.ndarray:
    """spread() of arrays."""
    out = np.full(len(ids[0]), seed % (1 << 31), np.int64)
    for i in ids:
        out = (i % (1 << 31) * 2654435 + out * 40503 + 12345) % (1 << 32)
    return (out % (1 << 31) * 1597334 + out // 65536 * 2654435) % (1 << 32)


def spread_sql(seed: int, *ids: str) -> str:
    """spread() as SQL."""
    out = str(seed % (1 << 31))
    for i in ids:
        out = f"(((({i}) % 2147483648 + 2147483648) % 2147483648 * 2654435 + ({out}) * 40503 + 12345) % 4294967296)"
    return f"((({out}) % 2147483648 * 1597334 + CAST(floor(({out}) / 65536) AS BIGINT) * 2654435) % 4294967296)"
