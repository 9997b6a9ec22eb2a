"""Graph cleaning, label propagation, community statistics, subgraphs, contraction and sampling, all as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.core import MISC, spread, super_id

from . import moves
from .storage import saved


@dataclass
class Graph:
    """nodes (id, label, features), edges (src, dst: simple and symmetric), masks (id, split; some nodes have none)."""

    nodes: DataFrame
    edges: DataFrame
    masks: DataFrame


# --- cleaning -------------------------------------------------------------------------------------------------------


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, without self-loops. Null ends are left out. An edge and its reverse meet as
    one canonical pair, so the shuffle carries half of what both directions would."""
    pairs = edges.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.explode(both).alias("e")).select("e.src", "e.dst")


def validate(edges: DataFrame) -> DataFrame:
    """One row: n_edges, n_self_loops, n_pairs (undirected, loops included), n_expected, is_clean."""
    by_pair = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("ways"))
    out = by_pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_edges"),
        F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("n_self_loops"),
        F.count("*").alias("n_pairs"),
    )
    return out.withColumn("n_expected", F.col("n_pairs") * 2).withColumn("is_clean", (F.col("n_edges") == F.col("n_expected")) & (F.col("n_self_loops") == 0))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti")


def with_self_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges, and a loop on each node."""
    return edges.select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


# --- communities ----------------------------------------------------------------------------------------------------


def votes(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, community_id, n): how many in-neighbours of a node have a label."""
    return edges.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "community_id").agg(F.count("*").alias("n"))


def label_propagation(nodes: DataFrame, edges: DataFrame, iterations: int = 5, until_stable: bool = False) -> DataFrame:
    """(id, community_id): synchronous label propagation. Each node starts with its own id and takes, in each of
    exactly `iterations` rounds, the label most frequent among its in-neighbours, the largest of equals; without
    in-neighbours it keeps its own. until_stable ends sooner once no label changes; labels may also oscillate.

    A round is a join, an aggregate and a left join; counts are combined before they are shuffled, so a hub's votes
    arrive as one row per label and task. Labels are written after every round, which ends the lineage.
    """
    labels = nodes.select("id", F.col("id").alias("community_id"))
    for i in range(iterations):
        best = votes(labels, edges).groupBy("id").agg(F.max(F.struct("n", "community_id"))["community_id"].alias("best"))
        after = labels.join(best, "id", "left").select("id", F.coalesce("best", "community_id").alias("community_id"), (F.col("best") != F.col("community_id")).alias("moved"))
        if i + 1 == iterations and not until_stable:
            return after.drop("moved")
        after = saved(after, "labels")
        labels = after.drop("moved")
        if until_stable and not after.where("moved").limit(1).count():
            break
    return labels


def label_propagation_halves(nodes: DataFrame, edges: DataFrame, rounds: int = 5, seed: int = 42) -> DataFrame:
    """(id, community_id): label propagation in which a seeded half of the nodes moves at a time and sees the other
    half's new labels, so that two sides of a bipartite graph can't swap labels for ever. Ties, isolated nodes and
    cost are as in label_propagation(); deterministic under the seed."""
    labels = nodes.select("id", F.col("id").alias("community_id"))
    for i in range(2 * rounds):
        turn = F.pmod(spread(seed + i // 2, F.col("id")), F.lit(2)) == i % 2
        best = votes(labels, edges).where(turn).groupBy("id").agg(F.max(F.struct("n", "community_id"))["community_id"].alias("best"))
        labels = saved(labels.join(best, "id", "left").select("id", F.coalesce("best", "community_id").alias("community_id")), "labels")
    return labels


def modularity(communities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modularity, of a symmetric edge list."""
    at = edges.join(communities.toDF("src", "cs"), "src").join(communities.toDF("dst", "cd"), "dst")
    per = at.groupBy("cs").agg(F.count("*").alias("d"), F.sum((F.col("cs") == F.col("cd")).cast("long")).alias("inside"))
    return per.agg(F.sum("d").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("d").cast("double") * F.col("d")).alias("s")).select((F.col("i") / F.col("m") - F.col("s") / F.col("m") / F.col("m")).alias("modularity"))


def _weighted(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.col("w") if "w" in edges.columns else F.lit(1).cast("long").alias("w"))


def local_moves(state: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 42, most_rounds: int = 30, within: bool = False, least_gain: float = 1e-4) -> DataFrame:
    """state (id, c, k, p): the nodes' communities and weighted degrees, after moves by gain in modularity. A seeded half of the nodes moves at a
    time, so that neighbours that move together can't swap for ever. Ends after a round of both halves that raises modularity by less than
    least_gain, or lowers it, in which case the state before stays; at most most_rounds. within: a node joins communities of its own p
    only. edges: (src, dst, w), symmetric, loops once with their weight counted twice."""
    m2 = edges.agg(F.sum("w")).first()[0]
    if not m2:
        return state
    best_state, best = state, weighted_modularity(state, edges, m2, resolution)
    for i in range(most_rounds * 2):
        totals = state.groupBy("c").agg(F.sum("k").alias("total"))
        ends_ = edges.where("src != dst").join(state.select(F.col("id").alias("dst"), "c", F.col("p").alias("pd")), "dst")
        links = ends_.groupBy(F.col("src").alias("id"), "c", "pd").agg(F.sum("w").alias("w"))
        mine = state.select("id", "k", "p", F.col("c").alias("now"))
        own = state.select("id", "c", F.col("p").alias("pd"), F.lit(0).cast("long").alias("w"))
        options = links.unionByName(own).groupBy("id", "c", "pd").agg(F.sum("w").alias("w")).join(mine, "id")
        options = options.where("pd = p") if within else options.groupBy("id", "c", "k", "p", "now").agg(F.sum("w").alias("w"))
        options = options.join(totals, "c")
        rest = F.col("total") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0)
        gain = F.col("w") - F.lit(resolution) * F.col("k") * rest / F.lit(m2)
        moved = options.groupBy("id").agg(F.max(F.struct(F.round(gain, 9).alias("g"), (F.col("c") == F.col("now")).alias("stay"), (-F.col("c")).alias("c"))).alias("b"))
        turn = F.pmod(spread(seed + i // 2, F.col("id")), F.lit(2)) == i % 2
        state = saved(state.join(moved, "id").select("id", F.when(turn, -F.col("b.c")).otherwise(F.col("c")).alias("c"), "k", "p"), "louvain")
        if i % 2:
            now = weighted_modularity(state, edges, m2, resolution)
            gained = now - best
            best_state, best = (state, now) if gained > 0 else (best_state, best)
            if gained < least_gain:
                break
    return best_state


def weighted_modularity(state: DataFrame, edges: DataFrame, m2: float, resolution: float = 1.0) -> float:
    at = edges.join(state.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(state.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst")
    inside = at.where("cs = cd").agg(F.sum("w")).first()[0] or 0
    squares = state.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t").cast("double") * F.col("t"))).first()[0]
    return inside / m2 - resolution * squares / m2 / m2


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, seed: int = 42, refine: bool = False, most_levels: int = 10, least_gain: float = 1e-4) -> DataFrame:
    """(id, community_id): Louvain's communities, or Leiden's with `refine`. At each level nodes move by gain in modularity until that ends; then
    communities become the nodes of a smaller weighted graph, until none moves there. refine: what becomes a node is a part of
    a community found by moves within it, from single nodes, and starts in its community, so that badly connected communities can
    fall apart. From the first level of at most moves.MOST_EDGES edges on, levels are one task's arrays, by the same moves. A node's smallest member names it. Isolated nodes are communities of their own. Every level's tables are written; deterministic under the seed."""
    graph = saved(_weighted(edges).groupBy("src", "dst").agg(F.sum("w").alias("w")), "level")
    place = nodes.select("id", F.col("id").alias("at"))
    degree = lambda g: g.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    state = place.select("id", F.col("id").alias("c")).join(degree(graph), "id", "left").na.fill(0, ["k"]).withColumn("p", F.lit(0).cast("long"))
    state = saved(state, "louvain")
    for done in range(most_levels):
        if graph.count() <= moves.MOST_EDGES:
            rows = state.select(F.lit(False).alias("is_edge"), F.col("id").alias("a"), F.col("c").alias("b"), F.lit(0).cast("long").alias("w")).unionByName(graph.select(F.lit(True).alias("is_edge"), F.col("src").alias("a"), F.col("dst").alias("b"), "w"))
            up = saved(rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInArrow(moves.finish(resolution, seed, refine, most_levels - done, least_gain), "at long, c long"), "levels")
            place = place.select("id", "at").join(up, "at").select("id", F.col("at"), "c")
            break
        found = local_moves(state, graph, resolution, seed, least_gain=least_gain)
        parts = found.select("id", F.col("c").alias("part"), "c")
        if refine:
            single = found.select("id", F.col("id").alias("c"), "k", F.col("c").alias("p"))
            parts = local_moves(single, graph, resolution, seed + 1, within=True, least_gain=least_gain).select("id", F.col("c").alias("part"), F.col("p").alias("c"))
        names = parts.groupBy("part").agg(F.min("id").alias("node"), F.min("c").alias("c"))
        parts = saved(parts.select("id", "part").join(names, "part").select("id", "node", "c"), "parts")
        place = saved(place.select("id", "at").join(parts.select(F.col("id").alias("at"), "node", "c"), "at").select("id", F.col("node").alias("at"), "c"), "place")
        before, after = state.count(), parts.select("node").distinct().count()
        if after == before:
            break
        to = parts.select("id", "node")
        graph = saved(graph.join(to.toDF("src", "a"), "src").join(to.toDF("dst", "b"), "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), "level")
        state = names.select(F.col("node").alias("id"), "c")
        state = saved(state.join(degree(graph), "id", "left").na.fill(0, ["k"]).withColumn("p", F.lit(0).cast("long")), "louvain")
    named = place.join(place.groupBy("c").agg(F.min("id").alias("community_id")), "c")
    return named.select("id", "community_id")


def edge_cut(parts: DataFrame, edges: DataFrame) -> int:
    """How many undirected edges join nodes of different parts."""
    return ends(edges.where("src < dst"), parts).where("c_src != c_dst").count()


def kway_parts(nodes: DataFrame, edges: DataFrame, k: int, seed: int = 42, rounds: int = 8, tolerance: float = 0.05, by: DataFrame | None = None) -> DataFrame:
    """(id, community_id from 0 to k - 1): balanced_parts() after moves that lower the number of edges cut. In each round, nodes of a seeded half that have
    more neighbours in another part than in their own ask to move there; between two parts as many go one way as the other,
    up to the same rank by (gain, hash), found from counts, so that no task holds a part. A round that doesn't lower the cut, or
    leaves a part with over 1 + tolerance of its share, is undone, and ends it after both halves have failed."""
    parts = saved(balanced_parts(nodes, k, seed, by), "kway")
    cut, failed, share = edge_cut(parts, edges), 0, nodes.count() / max(k, 1)
    for i in range(rounds * 2):
        near = ends(edges, parts).groupBy(F.col("src").alias("id"), "c_src", "c_dst").agg(F.count("*").alias("n"))
        own = near.where("c_src = c_dst").select("id", F.col("n").alias("own"))
        other = near.where("c_src != c_dst").groupBy("id", "c_src").agg(F.max(F.struct("n", (-F.col("c_dst")).alias("to"))).alias("b"))
        turn = F.pmod(spread(seed + i // 2, F.col("id")), F.lit(2)) == i % 2
        asked = other.join(own, "id", "left").select("id", F.col("c_src").alias("a"), (-F.col("b.to")).alias("b"), (F.col("b.n") - F.coalesce("own", F.lit(0))).alias("gain")).where("gain > 0").where(turn)
        asked = saved(asked.withColumn("h", F.floor(spread(seed + 77, F.col("id")) / F.lit(1 << 22)).cast("int")), "asked")
        strata = asked.groupBy("a", "b", "gain", "h").agg(F.count("*").alias("n"))
        upto = Window.partitionBy("a", "b").orderBy(F.desc("gain"), "h").rowsBetween(Window.unboundedPreceding, 0)
        strata = strata.withColumn("upto", F.sum("n").over(upto))
        totals = asked.groupBy("a", "b").agg(F.count("*").alias("asked"))
        both = totals.join(totals.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("asked").alias("back")), ["a", "b"]).select("a", "b", F.least("asked", "back").alias("room"))
        go = strata.join(both, ["a", "b"]).where("upto <= room").select("a", "b", "gain", "h")
        moves = asked.join(go, ["a", "b", "gain", "h"]).select("id", F.col("b").alias("_to"))
        after = saved(parts.join(moves, "id", "left").select("id", F.coalesce("_to", "community_id").alias("community_id")), "kway")
        now, largest = edge_cut(after, edges), after.groupBy("community_id").count().agg(F.max("count")).first()[0] or 0
        if now < cut and largest <= max(share * (1 + tolerance), share + 1):
            parts, cut, failed = after, now, 0
        else:
            failed += 1
            if failed == 2:
                break
    return parts


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place from 0 in `order`, which tells all rows apart: places within sorted ranges, and the ranges' counts, which are as few as partitions."""
    ranked = saved(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranked.join(F.broadcast(starts), "_range").withColumn(name, place).drop("_range", "_start")


def balanced_parts(nodes: DataFrame, k: int, seed: int = 42, by: DataFrame | None = None) -> DataFrame:
    """(id, community_id from 0 to k - 1): parts whose sizes differ by one at most. With `by` (id, community_id), nodes
    of one community lie side by side, so most of its edges stay within a part; others follow a seeded hash."""
    placed = nodes.select("id") if by is None else nodes.select("id").join(by, "id", "left")
    group = F.lit(0).cast("long") if by is None else F.coalesce("community_id", "id")
    ranked = numbered(placed.select("id", group.alias("g"), spread(seed, F.col("id")).alias("h")), ["g", "h", "id"])
    total = nodes.count()
    return ranked.select("id", F.floor(F.col("place") * k / F.lit(max(total, 1))).cast("long").alias("community_id"))


def community_sizes(communities: DataFrame) -> DataFrame:
    return communities.groupBy("community_id").agg(F.count("*").alias("size"))


def size_stats(sizes: DataFrame) -> DataFrame:
    """One row; the median is the lower of the two in the middle."""
    return sizes.agg(F.count("*").alias("n_communities"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.round(F.avg("size"), 6).alias("avg_size"), F.expr("percentile_approx(size, 0.5, 1000000)").alias("median_size"))


#: Names and least sizes of the classes in which communities are counted; the last has no upper bound.
BUCKETS = (("1-9", 1), ("10-49", 10), ("50-99", 50), ("100-499", 100), ("500+", 500))


def size_buckets(sizes: DataFrame) -> DataFrame:
    """(bucket, n_communities, n_nodes) of each of the five classes that has communities."""
    bucket = F.when(F.col("size") < BUCKETS[1][1], BUCKETS[0][0])
    for (name, _), (_, above) in zip(BUCKETS[1:], BUCKETS[2:], strict=False):
        bucket = bucket.when(F.col("size") < above, name)
    return sizes.groupBy(bucket.otherwise(BUCKETS[-1][0]).alias("bucket")).agg(F.count("*").alias("n_communities"), F.sum("size").alias("n_nodes"))


def top_communities(sizes: DataFrame, n: int = 10) -> DataFrame:
    return sizes.orderBy(F.desc("size"), "community_id").limit(n)


def coverage(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: nodes, those with a community, those without, and the share with, in percent."""
    flagged = nodes.select("id").join(communities.select("id", F.lit(1).alias("has")), "id", "left")
    out = flagged.agg(F.count("*").alias("n_nodes"), F.count("has").alias("n_assigned"))
    return out.withColumn("n_unassigned", F.col("n_nodes") - F.col("n_assigned")).withColumn("pct_assigned", F.round(F.when(F.col("n_nodes") > 0, 100.0 * F.col("n_assigned") / F.col("n_nodes")).otherwise(0.0), 6))


def nmi(communities: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: mutual information of label and community over the mean of their entropies; 1 if both are 0."""
    cells = communities.join(nodes.select("id", "label"), "id").groupBy("label", "community_id").agg(F.count("*").alias("n"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))
    all_ = cells.agg(F.sum("n").cast("double").alias("total"))
    joined = cells.join(side("label").withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l"))).join(side("community_id"), "community_id").crossJoin(F.broadcast(all_))
    mutual = joined.agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("total") * F.col("n") / F.col("n_label") / F.col("n_community_id"))).alias("mi"))
    entropy = lambda c, name: side(c).crossJoin(F.broadcast(all_)).agg((-F.sum(F.col(f"n_{c}") / F.col("total") * F.log(F.col(f"n_{c}") / F.col("total")))).alias(name))
    out = mutual.crossJoin(entropy("label", "hl")).crossJoin(entropy("community_id", "hc"))
    return out.select(F.round(F.when(F.col("hl") + F.col("hc") > 0, F.col("mi") / ((F.col("hl") + F.col("hc")) / 2)).otherwise(1.0), 6).alias("nmi"))


# --- subgraphs ------------------------------------------------------------------------------------------------------


def min_size(communities: DataFrame, least: int, small: str = "misc") -> DataFrame:
    """Communities under `least` nodes go ("drop") or become the one community MISC ("misc").
    Sizes are aggregated and joined, so a community of any size is never in one task."""
    if small not in ("misc", "drop"):
        raise ValueError("small communities are either 'misc' or 'drop'")
    valid = community_sizes(communities).where(F.col("size") >= least).select("community_id", F.lit(True).alias("_valid"))
    if small == "drop":
        return communities.join(valid, "community_id", "left_semi").select("id", "community_id")
    return communities.join(valid, "community_id", "left").select("id", F.when(F.col("_valid"), F.col("community_id")).otherwise(F.lit(MISC).cast("long")).alias("community_id"))


def ends(edges: DataFrame, communities: DataFrame, how: str = "inner") -> DataFrame:
    """(src, dst, c_src, c_dst) of edges whose source has a community; with `left`, targets may have none."""
    return edges.join(communities.toDF("src", "c_src"), "src").join(communities.toDF("dst", "c_dst"), "dst", how).select("src", "dst", "c_src", "c_dst")


def intra_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    return ends(edges, communities).where("c_src = c_dst").select("src", "dst", F.col("c_src").alias("community_id"))


def expanded_edges(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """All edges between nodes with a community, each in that of its source."""
    return ends(edges, communities).select("src", "dst", F.col("c_src").alias("community_id"))


def halo(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(id, community_id): nodes one step outside of a community."""
    return ends(edges, communities).where("c_src != c_dst").select(F.col("dst").alias("id"), F.col("c_src").alias("community_id")).distinct()


def expanded_nodes(graph: Graph, communities: DataFrame) -> DataFrame:
    """(id, label, features, split, community_id, is_core) of members and halo."""
    core = communities.select("id", "community_id", F.lit(True).alias("is_core"))
    member = core.unionByName(halo(graph.edges, communities).withColumn("is_core", F.lit(False)))
    return graph.nodes.join(graph.masks, "id", "left").join(member, "id").select("id", "label", "features", "split", "community_id", "is_core")


def boundary(edges: DataFrame, communities: DataFrame, rule: str = "intra_degree", expand: bool = True) -> DataFrame:
    """(id, is_boundary) of each node with a community: whether an edge leaves it, also to nodes without one.
    rule="as_run" compares degrees with the edges kept instead: under expansion, only edges to nodes without a
    community count."""
    if rule not in ("intra_degree", "as_run"):
        raise ValueError("the boundary rule is 'intra_degree' or 'as_run'")
    leaves = F.col("c_dst").isNull() if rule == "as_run" and expand else ~F.col("c_src").eqNullSafe(F.col("c_dst"))
    flags = ends(edges, communities, "left").groupBy(F.col("src").alias("id")).agg(F.bool_or(leaves).alias("f"))
    return communities.select("id").join(flags, "id", "left").select("id", F.coalesce("f", F.lit(False)).alias("is_boundary"))


def subgraph_metrics(edges: DataFrame, communities: DataFrame, least: int, small: str = "misc") -> DataFrame:
    """One row on what min_size() keeps and how many edges stay within communities."""
    kept = min_size(communities, least, small)
    inside = F.col("c_src").eqNullSafe(F.col("c_dst"))
    per = ends(edges, kept, "left").groupBy(F.col("src").alias("id")).agg(F.bool_or(~inside).cast("long").alias("leaves"), F.sum(inside.cast("long")).alias("stay"))
    nodes_ = kept.select("id").join(per, "id", "left").agg(F.count("*").alias("n_nodes_kept"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("n_boundary"), F.coalesce(F.sum("stay"), F.lit(0)).alias("n_intra_edges"))
    sizes = community_sizes(communities).agg(F.count("*").alias("n_comms_raw"), F.sum((F.col("size") >= least).cast("long")).alias("n_valid_comms"))
    out = sizes.crossJoin(nodes_).crossJoin(edges.agg(F.count("*").alias("n_edges")))
    out = out.withColumn("n_internal", F.col("n_nodes_kept") - F.col("n_boundary"))
    return out.withColumn("pct_edges_kept", F.round(F.when(F.col("n_edges") > 0, 100.0 * F.col("n_intra_edges") / F.col("n_edges")).otherwise(0.0), 6))


def bins(sizes: DataFrame, per_bin: int = 50, alone_over: int = 200) -> DataFrame:
    """(community_id, size, bin_id): up to `alone_over` communities, they are dealt in order of size to bins of
    some `per_bin`; beyond, each has its own, numbered by rank. One row per community passes through one task."""
    ranked = sizes.select("community_id", "size", (F.row_number().over(Window.orderBy(F.desc("size"), "community_id")) - 1).alias("rank"), F.count("*").over(Window.partitionBy()).alias("n"))
    return ranked.select("community_id", "size", F.when(F.col("n") > alone_over, F.col("rank")).otherwise(F.col("rank") % F.ceil(F.col("n") / per_bin)).cast("long").alias("bin_id"))


# --- contraction ----------------------------------------------------------------------------------------------------


def major(communities: DataFrame, least: int) -> DataFrame:
    return community_sizes(communities).where(F.col("size") >= least).select("community_id")


def centroids(graph: Graph, communities: DataFrame, least: int, scope: str = "all") -> DataFrame:
    """(community_id, features): the mean of each major community's features; scope="masked" takes only nodes with a split.
    Vectors, of one length, are added up whole, before the shuffle as well."""
    if scope not in ("all", "masked"):
        raise ValueError("a centroid's scope is 'all' or 'masked'")
    members = communities.join(major(communities, least), "community_id", "left_semi")
    members = members.join(graph.masks, "id", "left_semi") if scope == "masked" else members
    wide = members.join(graph.nodes.select("id", "features"), "id").where("features is not null")
    return _means(wide, F.col("community_id"))


def _means(rows: DataFrame, key: Column) -> DataFrame:
    """(key, features): means of vectors by key."""
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.transform("features", lambda x: x.cast("double"))))).alias("features"))


def mapped(communities: DataFrame, least: int) -> DataFrame:
    """(id, mapped, community_id, is_major): nodes of major communities stand as their super-node."""
    flag = major(communities, least).withColumn("_major", F.lit(True))
    out = communities.join(flag, "community_id", "left")
    return out.select("id", F.when(F.col("_major"), super_id(F.col("community_id"))).otherwise(F.col("id")).alias("mapped"), "community_id", F.coalesce("_major", F.lit(False)).alias("is_major"))


def contracted_edges(edges: DataFrame, communities: DataFrame, least: int) -> DataFrame:
    """(src_mapped, dst_mapped), distinct: edges between super-nodes and nodes of minor communities."""
    at = mapped(communities, least).select("id", "mapped")
    both = edges.join(at.toDF("src", "src_mapped"), "src").join(at.toDF("dst", "dst_mapped"), "dst")
    return both.where("src_mapped != dst_mapped").select("src_mapped", "dst_mapped").distinct()


def local_edges(edges: DataFrame, communities: DataFrame, least: int) -> DataFrame:
    """(community_id, src, dst), distinct: for each major community, its nodes' edges, with nodes of other major
    communities standing as super-nodes."""
    at = mapped(communities, least)
    out = edges.join(at.where("is_major").select(F.col("id").alias("src"), F.col("community_id").alias("m")), "src").join(at.select(F.col("id").alias("dst"), "mapped", F.col("community_id").alias("c")), "dst")
    target = F.when(F.col("c") == F.col("m"), F.col("dst")).otherwise(F.col("mapped"))
    return out.select(F.col("m").alias("community_id"), "src", target.alias("dst")).distinct()


def minor_edges(edges: DataFrame, communities: DataFrame, least: int, masks: DataFrame | None = None) -> DataFrame:
    """The contracted edges that super-nodes and minor nodes have among themselves; with masks, of minor nodes with a split."""
    out = contracted_edges(edges, communities, least)
    if masks is None:
        return out
    keep = masks.select("id")
    for c in ("src_mapped", "dst_mapped"):
        out = out.join(keep.withColumn("_in", F.lit(True)).withColumnRenamed("id", c), c, "left").where((F.col(c) <= -1000) | F.col("_in")).drop("_in")
    return out.select("src_mapped", "dst_mapped")


def local_stats(graph: Graph, communities: DataFrame, least: int) -> DataFrame:
    """(community_id, n_nodes, n_local_edges, n_supers, n_minors): the size of each major community's local graph."""
    at = mapped(communities, least)
    local = local_edges(graph.edges, communities, least)
    tagged = local.join(at.where("not is_major").select(F.col("id").alias("dst"), F.lit(True).alias("_minor")), "dst", "left")
    per = tagged.groupBy("community_id").agg(F.count("*").alias("n_local_edges"), F.countDistinct(F.when(F.col("dst") <= -1000, F.col("dst"))).alias("n_supers"), F.countDistinct(F.when(F.col("_minor"), F.col("dst"))).alias("n_minors"))
    sizes = at.where("is_major").groupBy("community_id").agg(F.count("*").alias("n_nodes"))
    return sizes.join(per, "community_id", "left").na.fill(0)


# --- sampling and features ------------------------------------------------------------------------------------------


def random_split(nodes: DataFrame, seed: int = 42, train: float = 0.6, valid: float = 0.2) -> DataFrame:
    """(id, split): an exact share of the nodes in order of a seeded hash. Ranks come from sorted ranges and their
    counts, so no task holds all nodes."""
    parts = balanced_parts(nodes, 1000, seed)
    return parts.select("id", F.when(F.col("community_id") < round(1000 * train), "train").when(F.col("community_id") < round(1000 * (train + valid)), "valid").otherwise("test").alias("split"))


def edge_sample(edges: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most `most` edges in order of a seeded hash: the cap on a message-passing graph."""
    return edges.withColumn("_h", spread(seed, F.col("src"), F.col("dst"))).orderBy("_h", "src", "dst").limit(most).drop("_h")


def link_split(edges: DataFrame, seed: int = 42, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """(src, dst, split) of each undirected edge once, by a seeded hash of the pair."""
    h = spread(seed, F.col("src"), F.col("dst")) % 1000
    return edges.where("src < dst").select("src", "dst", F.when(h < round(1000 * train), "train").when(h < round(1000 * (train + valid)), "valid").otherwise("test").alias("split"))


def negative_samples(edges: DataFrame, nodes: DataFrame, seed: int = 42) -> DataFrame:
    """Distinct (src, dst) that are no edge: for each undirected edge, a seeded partner of its source among all nodes, by its place in order of id."""
    places, n = numbered(nodes.select(F.col("id").alias("dst")), ["dst"]), nodes.count()
    drawn = edges.where("src < dst").select("src", (spread(seed, F.col("src"), F.col("dst")) % max(n, 1)).alias("place")).distinct()
    return drawn.join(places, "place").where("src != dst").select("src", "dst").join(edges, ["src", "dst"], "left_anti")


def neighbor_sample(edges: DataFrame, fanout: int, seed: int = 42) -> DataFrame:
    """(src, dst): at most `fanout` in-neighbours of each node, in order of a seeded hash."""
    h = spread(seed, F.col("src"), F.col("dst"))
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("dst").orderBy(h, "src"))).where(F.col("_n") <= fanout).select("src", "dst")


def mean_aggregate(features: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, features): the mean of the in-neighbours' features, vectors of one length. One layer of mean aggregation; a row per edge is shuffled, sums before that."""
    return _means(edges.join(features.where("features is not null").withColumnRenamed("id", "src"), "src"), F.col("dst").alias("id"))


def edge_scores(edges: DataFrame, nodes: DataFrame, decoder: Column) -> DataFrame:
    """(src, dst, score) with `decoder` over the ends' features, columns a and b."""
    x = nodes.select("id", "features")
    return edges.join(x.toDF("src", "a"), "src").join(x.toDF("dst", "b"), "dst").select("src", "dst", decoder.alias("score"))
