"""URL filter: a sort-merge range join of reversed-host keys with prefix rules. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import even_join, lower_ascii, saved

RULES = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _SPLIT, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def _canonical(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _below(inner: DataFrame, keys: list[str], length: str, prefix: Column) -> DataFrame:
    """(keys, below): the longest other rule whose `length` part of the last key is a prefix of a rule's own, if there is one. Only lengths
    that the rules have are tried. `prefix` is the last key cut to `_n`."""
    *group, last = keys
    lengths = inner.groupBy(*group).agg(F.collect_set(length).alias("_lengths"))
    tried = (inner.join(lengths, group) if group else inner.crossJoin(F.broadcast(lengths))).select(*keys, length, F.explode("_lengths").alias("_n")).where(F.col("_n") < F.col(length))
    tried = tried.select(*group, F.col(last).alias("_own"), prefix.alias(last))
    return tried.join(inner.select(*keys, length), keys).groupBy(*group, F.col("_own").alias(last)).agg(F.max_by(last, length).alias("below"))


def _events(rules: DataFrame, group: list[str], start: Column, top: str) -> DataFrame:
    """(group, key, kind, top): each rule's interval as two events, from its key to that key and byte FF, each with what it leaves on
    top of the stack: the rule itself, or the one below it (\"\\0\" for none)."""
    opened = F.struct(start.alias("key"), F.lit(0).alias("kind"), F.col(top).alias("top"))
    closed = F.struct(F.concat(start, F.lit(bytes([255]))).alias("key"), F.lit(2).alias("kind"), F.coalesce("below", F.lit(NONE)).alias("top"))
    return rules.select(*group, F.explode(F.array(opened, closed)).alias("e")).select(*group, "e.*")


def _sweep(rows: DataFrame, order: list[str], ranges: int | None) -> DataFrame:
    """rows with `top` filled from the last one before, in `order`. Rows are dealt to ranges of that order and swept in each; the
    rule that lies on top at a range's border is carried over from the ranges before, which are as few as partitions."""
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    dealt = saved(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy("_range").agg(F.max(F.when(F.col("top").isNotNull(), F.struct(*order, "top")))["top"].alias("_end"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(ends.select("_range", F.last("_end", ignorenulls=True).over(before).alias("_carried")))
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("top", F.last("top", ignorenulls=True).over(here)).join(carried, "_range")
    return swept.withColumn("top", F.coalesce("top", "_carried")).drop("_range", "_carried")


NONE = "\0"


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", ranges: int | None = None) -> DataFrame:
    """Judge each row of `pages` by the longest rule that fits its url; keeps all its columns and adds
    url_host, url_path, url_rule and url_verdict (columns of these names are replaced).

    rules: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts
    with the rule's. The longest host + path wins; of equal length, the longer host. A rule given
    twice counts once, and `block` wins over `allow`. Rules with a null host, path or verdict are
    left out. A null url, or one without `://`, has empty host and path and the default verdict, as
    has a url without a rule. Empty tables give an empty result, or all defaults.

    Method: a prefix is an interval, from its key to that key followed by byte FF, and such intervals nest. A rule is one
    interval of reversed hosts, which end with a dot, and within these one of paths; as a rule's path holds for all subdomains, it is
    no single interval of host and path together. So there are two sorted sweeps of the same kind. The first runs over reversed hosts: the stack
    of open rules' hosts tells which hosts' rules may fit. The second runs over keys of such a host, reversed, and the url's path: its top is
    the host's longest rule that fits. What an event leaves on top is known from the rules alone; a url takes the last top before it, which
    is carried over the borders of the ranges that rows are dealt to (`ranges`, Spark's number of shuffle partitions where none is given).
    """
    rules = rules.dropna(subset=["host", "path", "verdict"])
    rules = rules.groupBy(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    rules = rules.select("r_host", F.concat(_canonical(F.col("r_host")), F.lit(".")).alias("rev"), "r_path", "r_verdict")
    hosts = rules.select("rev").distinct().withColumn("labels", F.size(F.split("rev", r"\.", -1)))
    cut = F.concat(F.array_join(F.slice(F.split("rev", r"\.", -1), F.lit(1), F.col("_n") - 1), "."), F.lit("."))
    under = hosts.join(_below(hosts, ["rev"], "labels", cut), "rev", "left")
    # A host's stack: itself and the rules' hosts that are its prefixes.
    shorter = hosts.select("rev", F.explode(F.sequence(F.lit(2), F.col("labels"))).alias("_n")).select(F.col("rev").alias("top"), cut.alias("rev")).join(hosts.select("rev"), "rev", "left_semi")
    stacks = shorter.groupBy("top").agg(F.collect_set("rev").alias("stack"))

    seen = pages.select(url_host(F.col(url)).alias("url_host"), url_path(F.col(url)).alias("url_path"))
    urls = saved(seen.distinct(), "urls")
    none = F.lit(None).cast("string")
    named = urls.select("url_host").distinct().select(F.encode(F.concat(_canonical(F.col("url_host")), F.lit(".")), "UTF-8").alias("key"), F.lit(1).alias("kind"), none.alias("top"), "url_host")
    events = _events(under, [], F.encode("rev", "UTF-8"), "rev").withColumn("url_host", none)
    within = _sweep(named.unionByName(events), ["key", "kind"], ranges).where(F.col("kind") == 1).where(F.col("top") != NONE).select("url_host", "top")
    within = even_join(saved(within, "hosts"), stacks, "top").select("url_host", "stack")

    paths = rules.withColumn("_length", F.length("r_path"))
    below = _below(paths.select("rev", "r_path", "_length"), ["rev", "r_path"], "_length", F.expr("substring(r_path, 1, _n)"))
    events = _events(rules.join(below, ["rev", "r_path"], "left"), ["rev"], F.encode("r_path", "UTF-8"), "r_path").withColumns({"url_host": none, "url_path": none})
    keys = even_join(urls, within, "url_host").select(F.explode("stack").alias("rev"), F.encode("url_path", "UTF-8").alias("key"), F.lit(1).alias("kind"), none.alias("top"), "url_host", "url_path")
    # Of urls with one key the host decides, so that a range may end among them.
    fits = _sweep(keys.unionByName(events), ["rev", "key", "kind", "url_host"], ranges).where(F.col("kind") == 1).where(F.col("top") != NONE).withColumnRenamed("top", "r_path")
    found = fits.join(rules, ["rev", "r_path"]).groupBy("url_host", "url_path").agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    found = found.select(F.struct("url_host", "url_path").alias("_url"), F.col("best.rule").alias("url_rule"), F.col("best.verdict").alias("url_verdict"))
    out = pages.drop("url_host", "url_path", "url_rule", "url_verdict").withColumns({"url_host": url_host(F.col(url)), "url_path": url_path(F.col(url))}).withColumn("_url", F.struct("url_host", "url_path"))
    return even_join(out, saved(found, "verdicts"), "_url", "left").drop("_url").withColumn("url_verdict", F.coalesce("url_verdict", F.lit(default)))
