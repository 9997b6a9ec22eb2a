"""The graph engine's operators as queries over the driver's tables, each with its SQL.

The graph: parts that were ordered together and share a brand. Labels are brands, features are embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.core import dot, hadamard, l2_normalize, spread, spread_sql
from weftgraph.operators import graph as G
from weftgraph.operators import learn, metrics
from weftgraph.operators.storage import TableStore, shared_dir
from weftgraph.sources import graphs

LEAST, CLASSES, ROUNDS = 10, 26, 5
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
QUERIES = Q


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    items = _read(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(_read(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    a, b = items.toDF("src", "o", "brand"), items.toDF("dst", "o", "brand")
    return a.join(b, ["o", "brand"]).where("src < dst").select("src", "dst")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.count("*").alias("n"))
    parts = _read(spark, sf, "part").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("id"), F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("label"), (F.col("p_partkey") % F.col("n")).alias("vec_id"))
    return parts.join(e, "vec_id", "left").select("id", "label", F.col("embedding").alias("features"))


def masks(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("id") % 10
    ids = _read(spark, sf, "part").select(F.col("p_partkey").alias("id")).where("id % 50 != 7")
    return ids.select("id", F.when(r < 6, "train").when(r < 8, "valid").otherwise("test").alias("split"))


def graph(spark: SparkSession, sf: str) -> G.Graph:
    return G.Graph(nodes(spark, sf), G.saved(G.symmetrize(raw_edges(spark, sf)), "edges"), masks(spark, sf))


def communities(g: G.Graph, rounds: int = ROUNDS) -> DataFrame:
    return G.saved(G.label_propagation(g.nodes, g.edges, rounds), "communities")


# SQL of the fixture, and of label propagation round by round.
_NODES = "nodes AS MATERIALIZED (SELECT p_partkey AS id, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS label, embedding AS features FROM part LEFT JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"
_RAW = "x AS MATERIALIZED (SELECT l_orderkey AS o, p_partkey AS p, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey), original AS MATERIALIZED (SELECT a.p AS src, b.p AS dst FROM x a JOIN x b ON a.o = b.o AND a.b = b.b AND a.p < b.p)"
_EDGES = _RAW + ", edges AS MATERIALIZED (SELECT src, dst FROM original UNION SELECT dst, src FROM original)"
_MASKS = "masks AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 < 6 THEN 'train' WHEN p_partkey % 10 < 8 THEN 'valid' ELSE 'test' END AS split FROM part WHERE p_partkey % 50 <> 7)"
_BASE = f"WITH {_NODES}, {_EDGES}, {_MASKS}"


def _lpa(rounds: int) -> str:
    out = ["c0 AS MATERIALIZED (SELECT id, id AS community_id FROM nodes)"]
    for i in range(rounds):
        out.append(f"v{i} AS MATERIALIZED (SELECT dst AS id, community_id, count(*) AS n FROM edges JOIN c{i} ON src = c{i}.id GROUP BY ALL)")
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.id, coalesce(best, c{i}.community_id) AS community_id FROM c{i} LEFT JOIN (SELECT id, arg_max(community_id, (n, community_id)) AS best FROM v{i} GROUP BY id) b USING (id))")
    return ", ".join(out)


_COMM = f"{_BASE}, {_lpa(ROUNDS)}, comm AS MATERIALIZED (SELECT * FROM c{ROUNDS}), sizes AS MATERIALIZED (SELECT community_id, count(*) AS size FROM comm GROUP BY 1)"
_MISC = f"{_COMM}, misc AS MATERIALIZED (SELECT id, CASE WHEN size >= {LEAST} THEN community_id ELSE -1 END AS community_id FROM comm JOIN sizes USING (community_id))"
_DROP = f"{_COMM}, kept AS MATERIALIZED (SELECT id, community_id FROM comm JOIN sizes USING (community_id) WHERE size >= {LEAST})"
_ENDS = "ends AS MATERIALIZED (SELECT src, dst, a.community_id AS c_src, b.community_id AS c_dst FROM edges JOIN {c} a ON src = a.id LEFT JOIN {c} b ON dst = b.id)"
_MAPPED = f"{_COMM}, mapped AS MATERIALIZED (SELECT id, CASE WHEN size >= {LEAST} THEN -1000 - community_id ELSE id END AS mapped, community_id, size >= {LEAST} AS is_major FROM comm JOIN sizes USING (community_id))"
_SUPER = "super AS MATERIALIZED (SELECT DISTINCT a.mapped AS src_mapped, b.mapped AS dst_mapped FROM edges JOIN mapped a ON src = a.id JOIN mapped b ON dst = b.id WHERE a.mapped <> b.mapped)"
_LOCAL = "local AS MATERIALIZED (SELECT DISTINCT a.community_id, src, CASE WHEN a.community_id = b.community_id THEN dst ELSE b.mapped END AS dst FROM edges JOIN mapped a ON src = a.id AND a.is_major JOIN mapped b ON dst = b.id)"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def over_graph(sql: str | None):
    """A query over (graph)."""

    def add(f):
        Q[f.__name__] = lambda spark, sf: f(graph(spark, sf))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PREPARED: dict[tuple[str, str], tuple[G.Graph, DataFrame]] = {}


def prepared(spark: SparkSession, sf: str) -> tuple[G.Graph, DataFrame]:
    """The graph of the tables in `sf` and its communities, found and written once in a session."""
    key = spark.sparkContext.applicationId, sf
    if key not in _PREPARED:
        g = graph(spark, sf)
        _PREPARED[key] = g, communities(g)
    return _PREPARED[key]


def over_communities(sql: str | None):
    """A query over (graph, communities)."""

    def add(f):
        Q[f.__name__] = lambda spark, sf: f(*prepared(spark, sf))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _add() -> None:
    lists = lambda df, c: df.select("id", F.posexplode(c).alias("dim", "x")).select("id", "dim", F.round(F.col("x").cast("double"), 6).alias("x"))
    wide = "f AS MATERIALIZED (SELECT id, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS dim FROM nodes)"

    query(f"WITH {_NODES} SELECT id, label, len(features) AS width FROM nodes")(_named("graph_nodes", lambda s, sf: nodes(s, sf).select("id", "label", F.size("features").cast("long").alias("width"))))
    query(f"WITH {_RAW} SELECT src, dst FROM original")(_named("graph_edges_raw", raw_edges))
    query(f"WITH {_EDGES} SELECT src, dst FROM edges")(_named("graph_symmetrize", lambda s, sf: G.symmetrize(raw_edges(s, sf))))
    query(f"WITH {_RAW}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM original GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_edges, CAST(coalesce(sum(n) FILTER (a = b), 0) AS BIGINT) AS n_self_loops, count(*) AS n_pairs, 2 * count(*) AS n_expected, sum(n) = 2 * count(*) AND coalesce(sum(n) FILTER (a = b), 0) = 0 AS is_clean FROM p")(_named("graph_validate", lambda s, sf: G.validate(raw_edges(s, sf))))
    over_graph(f"{_BASE} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges)")(_named("graph_isolated_nodes", lambda g: G.isolated(g.nodes, g.edges)))
    over_graph(f"{_BASE} SELECT id, count(src) AS degree FROM nodes LEFT JOIN edges ON src = id GROUP BY id")(_named("graph_degree", lambda g: G.degrees(g.nodes, g.edges)))
    over_graph(f"{_BASE} SELECT src, dst FROM edges UNION SELECT id, id FROM nodes")(_named("graph_self_loops", lambda g: G.with_self_loops(g.nodes, g.edges)))
    over_graph(f"{_BASE} SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM edges GROUP BY src")(_named("adjacency_lists", lambda g: G.adjacency(g.edges).select("id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))))
    query(f"WITH {_MASKS} SELECT id, split FROM masks")(_named("masks_split", masks))
    h = spread_sql(42, "id")
    query(f"WITH {_NODES}, r AS (SELECT id, CAST(floor((row_number() OVER (ORDER BY {h}, id) - 1) * 1000 / (SELECT count(*) FROM nodes)) AS BIGINT) AS p FROM nodes) SELECT id, CASE WHEN p < 600 THEN 'train' WHEN p < 800 THEN 'valid' ELSE 'test' END AS split FROM r")(_named("split_random_602020", lambda s, sf: G.random_split(nodes(s, sf))))

    for n in (1, 5):
        over_graph(f"{_BASE}, {_lpa(n)} SELECT id, community_id FROM c{n}")(_named(f"lpa_{n}_iter", lambda g, n=n: G.label_propagation(g.nodes, g.edges, n)))
    over_graph(f"{_BASE}, {_lpa(2)} SELECT id, community_id, n FROM v1")(_named("lpa_vote_counts", lambda g: G.votes(G.label_propagation(g.nodes, g.edges, 1), g.edges)))
    over_communities(f"{_COMM} SELECT community_id, size FROM sizes")(_named("community_sizes", lambda g, c: G.community_sizes(c)))
    over_communities(f"{_COMM} SELECT count(*) AS n_communities, min(size) AS min_size, max(size) AS max_size, round(avg(size), 6) AS avg_size, quantile_disc(size, 0.5) AS median_size FROM sizes")(_named("community_size_stats", lambda g, c: G.size_stats(G.community_sizes(c))))
    over_communities(f"{_COMM} SELECT CASE WHEN size < 10 THEN '1-9' WHEN size < 50 THEN '10-49' WHEN size < 100 THEN '50-99' WHEN size < 500 THEN '100-499' ELSE '500+' END AS bucket, count(*) AS n_communities, CAST(sum(size) AS BIGINT) AS n_nodes FROM sizes GROUP BY 1")(_named("community_size_buckets", lambda g, c: G.size_buckets(G.community_sizes(c))))
    over_communities(f"{_COMM} SELECT community_id, size FROM sizes ORDER BY size DESC, community_id LIMIT 10")(_named("community_top10", lambda g, c: G.top_communities(G.community_sizes(c))))
    over_communities(f"{_COMM}, k AS (SELECT id FROM comm WHERE community_id IN (SELECT community_id FROM sizes WHERE size >= {LEAST})) SELECT count(*) AS n_nodes, count(k.id) AS n_assigned, count(*) - count(k.id) AS n_unassigned, round(100.0 * count(k.id) / count(*), 6) AS pct_assigned FROM nodes LEFT JOIN k USING (id)")(_named("community_coverage", lambda g, c: G.coverage(g.nodes, G.min_size(c, LEAST, "drop"))))
    over_communities(
        f"""{_COMM}, t AS (SELECT label, community_id, count(*) AS n FROM comm JOIN nodes USING (id) GROUP BY ALL), l AS (SELECT label, sum(n) AS nl FROM t GROUP BY 1), k AS (SELECT community_id, sum(n) AS nk FROM t GROUP BY 1), z AS (SELECT sum(n)::DOUBLE AS n FROM t)
        SELECT round((SELECT sum(t.n / z.n * ln(z.n * t.n / nl / nk)) FROM t JOIN l USING (label) JOIN k USING (community_id), z) / (((SELECT -sum(nl / z.n * ln(nl / z.n)) FROM l, z) + (SELECT -sum(nk / z.n * ln(nk / z.n)) FROM k, z)) / 2), 6) AS nmi"""
    )(_named("community_nmi", lambda g, c: G.nmi(c, g.nodes)))

    over_communities(f"{_MISC} SELECT id, community_id FROM misc")(_named("minsize_misc", lambda g, c: G.min_size(c, LEAST)))
    over_communities(f"{_DROP} SELECT id, community_id FROM kept")(_named("minsize_drop", lambda g, c: G.min_size(c, LEAST, "drop")))
    misc_ends = f"{_MISC}, {_ENDS.format(c='misc')}"
    over_communities(f"{misc_ends} SELECT src, dst, c_src AS community_id FROM ends WHERE c_src = c_dst")(_named("intra_edges", lambda g, c: G.intra_edges(g.edges, G.min_size(c, LEAST))))
    over_communities(f"{misc_ends} SELECT DISTINCT dst AS id, c_src AS community_id FROM ends WHERE c_src <> c_dst")(_named("halo_nodes", lambda g, c: G.halo(g.edges, G.min_size(c, LEAST))))
    over_communities(f"{misc_ends}, m AS (SELECT id, community_id, true AS is_core FROM misc UNION ALL SELECT DISTINCT dst, c_src, false FROM ends WHERE c_src <> c_dst) SELECT m.id, label, split, community_id, is_core FROM m JOIN nodes USING (id) LEFT JOIN masks USING (id)")(_named("expanded_nodes", lambda g, c: G.expanded_nodes(g, G.min_size(c, LEAST)).drop("features")))
    over_communities(f"{misc_ends} SELECT src, dst, c_src AS community_id FROM ends WHERE c_dst IS NOT NULL")(_named("expanded_edges", lambda g, c: G.expanded_edges(g.edges, G.min_size(c, LEAST))))
    flag = "SELECT k.id, coalesce(f, false) AS is_boundary FROM kept k LEFT JOIN (SELECT src AS id, bool_or({w}) AS f FROM ends GROUP BY src) b USING (id)"
    drop_ends = f"{_DROP}, {_ENDS.format(c='kept')}"
    over_communities(f"{drop_ends} {flag.format(w='c_src IS DISTINCT FROM c_dst')}")(_named("boundary_nodes", lambda g, c: G.boundary(g.edges, G.min_size(c, LEAST, "drop"))))
    over_communities(f"{drop_ends} {flag.format(w='c_dst IS NULL')}")(_named("boundary_nodes_as_run", lambda g, c: G.boundary(g.edges, G.min_size(c, LEAST, "drop"), "as_run")))
    over_communities(
        f"""{misc_ends}, b AS (SELECT src, bool_or(c_src IS DISTINCT FROM c_dst) AS f FROM ends GROUP BY src) SELECT (SELECT count(*) FROM sizes) AS n_comms_raw, (SELECT count(*) FROM sizes WHERE size >= {LEAST}) AS n_valid_comms,
        (SELECT count(*) FROM misc) AS n_nodes_kept, (SELECT count(*) FROM b WHERE f) AS n_boundary, (SELECT count(*) FROM misc) - (SELECT count(*) FROM b WHERE f) AS n_internal,
        (SELECT count(*) FROM ends WHERE c_src = c_dst) AS n_intra_edges, (SELECT count(*) FROM edges) AS n_edges, round(100.0 * (SELECT count(*) FROM ends WHERE c_src = c_dst) / (SELECT count(*) FROM edges), 6) AS pct_edges_kept"""
    )(_named("subgraph_metrics", lambda g, c: G.subgraph_metrics(g.edges, c, LEAST)))
    over_communities(f"{_COMM}, r AS (SELECT *, row_number() OVER (ORDER BY size DESC, community_id) - 1 AS k, count(*) OVER () AS n FROM sizes WHERE size >= {LEAST}) SELECT community_id, size, CAST(CASE WHEN n > 200 THEN k ELSE k % CAST(ceil(n / 50) AS BIGINT) END AS BIGINT) AS bin_id FROM r")(_named("bin_packing", lambda g, c: G.bins(G.community_sizes(c).where(F.col("size") >= LEAST))))

    over_communities(f"{_MAPPED} SELECT id, mapped, community_id, is_major FROM mapped")(_named("major_minor", lambda g, c: G.mapped(c, LEAST)))
    for scope, extra in (("all", ""), ("masked", "JOIN masks USING (id)")):
        over_communities(f"{_MAPPED}, {wide} SELECT community_id, CAST(dim AS INTEGER) AS dim, round(avg(x::DOUBLE), 6) AS mean FROM f JOIN mapped USING (id) {extra} WHERE is_major GROUP BY ALL")(_named(f"super_centroids_{scope}", lambda g, c, scope=scope: G.centroids(g, c, LEAST, scope).select("community_id", F.posexplode("features").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))))
    over_communities(f"{_MAPPED}, {_SUPER} SELECT src_mapped, dst_mapped FROM super")(_named("super_edges", lambda g, c: G.contracted_edges(g.edges, c, LEAST)))
    over_communities(f"{_MAPPED}, {_LOCAL} SELECT community_id, src, dst FROM local")(_named("super_local_edges", lambda g, c: G.local_edges(g.edges, c, LEAST)))
    over_communities(f"{_MAPPED}, {_LOCAL} SELECT m.community_id, n_nodes, coalesce(e, 0) AS n_local_edges, coalesce(s, 0) AS n_supers, coalesce(k, 0) AS n_minors FROM (SELECT community_id, count(*) AS n_nodes FROM mapped WHERE is_major GROUP BY 1) m LEFT JOIN (SELECT l.community_id, count(*) AS e, count(DISTINCT dst) FILTER (dst <= -1000) AS s, count(DISTINCT dst) FILTER (NOT is_major) AS k FROM local l LEFT JOIN mapped p ON dst = p.id GROUP BY 1) t USING (community_id)")(_named("super_local_stats", lambda g, c: G.local_stats(g, c, LEAST)))
    over_communities(f"{_MAPPED}, {_SUPER} SELECT src_mapped, dst_mapped FROM super WHERE (src_mapped <= -1000 OR src_mapped IN (SELECT id FROM masks)) AND (dst_mapped <= -1000 OR dst_mapped IN (SELECT id FROM masks))")(_named("minor_graph_edges", lambda g, c: G.minor_edges(g.edges, c, LEAST, g.masks)))

    n2 = "sqrt(list_sum(list_transform(features, lambda v: v::DOUBLE * v::DOUBLE)))"
    over_graph(f"{_BASE}, {wide}, n AS (SELECT id, {n2} AS l FROM nodes) SELECT id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN l > 0 THEN x::DOUBLE / l ELSE 0 END, 6) AS x FROM f JOIN n USING (id)")(_named("l2_normalize", lambda g: lists(g.nodes.select("id", l2_normalize(F.col("features")).alias("v")), "v")))
    hop = "{b} AS MATERIALIZED (SELECT dst AS id, dim, avg(x::DOUBLE) AS x FROM edges JOIN {a} ON src = {a}.id GROUP BY ALL)"
    long = lambda df: df.select("id", F.posexplode("features").alias("dim", "x")).withColumn("x", F.round("x", 6))
    over_graph(f"{_BASE}, {wide}, {hop.format(a='f', b='h1')} SELECT id, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x FROM h1")(_named("mean_aggregate_1hop", lambda g: long(G.mean_aggregate(g.nodes, g.edges))))
    over_graph(f"{_BASE}, {wide}, {hop.format(a='f', b='h1')}, {hop.format(a='h1', b='h2')} SELECT id, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x FROM h2")(_named("mean_aggregate_2hop", lambda g: long(G.mean_aggregate(G.mean_aggregate(g.nodes, g.edges), g.edges))))
    items = "i AS (SELECT DISTINCT l_suppkey AS id, l_partkey % 300 AS item FROM lineitem), t AS (SELECT item, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, item LIMIT 128)"
    query(f"WITH {items} SELECT id, count(t.item) AS ones, CAST(coalesce(sum(t.item), 0) AS BIGINT) AS item_sum FROM i LEFT JOIN t USING (item) GROUP BY id")(_named("multi_hot_topk", _multi_hot))
    over_graph(f"{_BASE} SELECT src, dst FROM edges ORDER BY {spread_sql(42, 'src', 'dst')}, src, dst LIMIT 500")(_named("edge_cap_sample", lambda g: G.edge_sample(g.edges, 500)))
    over_graph(f"{_BASE}, h AS (SELECT src, dst, {spread_sql(42, 'src', 'dst')} % 1000 AS h FROM edges WHERE src < dst) SELECT src, dst, CASE WHEN h < 800 THEN 'train' WHEN h < 900 THEN 'valid' ELSE 'test' END AS split FROM h")(_named("link_split", lambda g: G.link_split(g.edges)))
    over_graph(f"{_BASE}, o AS (SELECT id AS dst, row_number() OVER (ORDER BY id) - 1 AS place FROM nodes), d AS (SELECT DISTINCT src, o.dst FROM edges JOIN o ON place = {spread_sql(42, 'src', 'edges.dst')} % (SELECT count(*) FROM nodes) WHERE src < edges.dst) SELECT d.src, d.dst FROM d LEFT JOIN edges e ON d.src = e.src AND d.dst = e.dst WHERE d.src <> d.dst AND e.src IS NULL")(_named("negative_samples", lambda g: G.negative_samples(g.edges, g.nodes)))
    over_graph(f"{_BASE} SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY dst ORDER BY {spread_sql(42, 'src', 'dst')}, src) <= 3")(_named("neighbor_sample_fanout", lambda g: G.neighbor_sample(g.edges, 3)))
    scored = f"{_BASE}, s AS (SELECT src, dst, list_transform(list_zip(a.features, b.features), lambda z: z[1]::DOUBLE * z[2]::DOUBLE) AS v FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id)"
    over_graph(f"{scored} SELECT src, dst, round(list_sum(v), 6) AS score FROM s")(_named("edge_dot_product", lambda g: G.edge_scores(g.edges, g.nodes, F.round(dot(F.col("a"), F.col("b")), 6))))
    over_graph(f"{scored} SELECT src, dst, round(list_max(v), 6) AS score FROM s")(_named("edge_hadamard_max", lambda g: G.edge_scores(g.edges, g.nodes, F.round(F.array_max(hadamard(F.col("a"), F.col("b"))), 6))))

    pred = f"p AS MATERIALIZED (SELECT id, label, CASE WHEN {spread_sql(7, 'id')} % 4 <> 0 THEN label ELSE label % 25 + 1 END AS predicted, {spread_sql(9, 'id')} % 1000 + label * 20 AS score FROM nodes)"
    over_graph(f"{_BASE}, {pred}, r AS (SELECT label <= 12 AS positive, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p) SELECT round((sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2) / count(*) FILTER (positive) / count(*) FILTER (NOT positive), 6) AS auc FROM r")(_named("auc_rank", lambda g: metrics.auc(predictions(g.nodes).withColumn("positive", F.col("label") <= 12))))
    over_graph(f"{_BASE}, {pred} SELECT split, round(avg((predicted = label)::INTEGER), 6) AS accuracy FROM p JOIN masks USING (id) GROUP BY split")(_named("masked_accuracy", lambda g: predictions(g.nodes).join(g.masks, "id").groupBy("split").agg(F.round(metrics.accuracy("predicted", "label"), 6).alias("accuracy"))))
    flagged = f"{misc_ends}, {pred}, b AS (SELECT k.id, k.community_id, coalesce(f, false) AS is_boundary FROM misc k LEFT JOIN (SELECT src AS id, bool_or(c_src IS DISTINCT FROM c_dst) AS f FROM ends GROUP BY src) USING (id)), e AS MATERIALIZED (SELECT p.*, community_id, is_boundary, split FROM p JOIN b USING (id) LEFT JOIN masks USING (id))"
    over_communities(f"{flagged} SELECT round(coalesce(avg((predicted = label)::INTEGER) FILTER (split = 'test' AND is_boundary), 0), 6) AS boundary_acc, round(coalesce(avg((predicted = label)::INTEGER) FILTER (split = 'test' AND NOT is_boundary), 0), 6) AS internal_acc FROM e")(_named("boundary_internal_accuracy", _boundary_accuracy))
    per = f"{flagged}, r AS MATERIALIZED (SELECT community_id, count(*) AS n_nodes, count(*) FILTER (split = 'test') AS n_test, coalesce(avg((predicted = label)::INTEGER) FILTER (split = 'test'), 0) AS accuracy FROM e GROUP BY 1)"
    over_communities(f"{per} SELECT round(coalesce(sum(accuracy * n_test) / nullif(sum(n_test), 0), 0), 6) AS accuracy, CAST(sum(n_test) AS BIGINT) AS n_test FROM r")(_named("weighted_accuracy", lambda g, c: community_results(g, c).agg(F.round(metrics.weighted("accuracy", "n_test"), 6).alias("accuracy"), F.sum("n_test").alias("n_test"))))
    over_communities(f"{per} SELECT CASE WHEN n_nodes > 200 THEN 'large' WHEN n_nodes >= 50 THEN 'medium' ELSE 'small' END AS size_bucket, count(*) AS n_communities, CAST(sum(n_test) AS BIGINT) AS n_test, round(coalesce(sum(accuracy * n_test) / nullif(sum(n_test), 0), 0), 6) AS accuracy FROM r GROUP BY 1")(_named("size_bucket_report", lambda g, c: metrics.by_bucket(community_results(g, c))))
    over_communities(f"{per} SELECT CAST(least(floor(accuracy * 40), 39) AS INTEGER) AS bin, count(*) AS n, round(CAST(least(floor(accuracy * 40), 39) AS INTEGER) * 1.0::DOUBLE / 40, 6) AS low FROM r GROUP BY 1")(_named("accuracy_histogram", lambda g, c: metrics.histogram(community_results(g, c), "accuracy")))
    timed = "SELECT 'd' || o_orderkey % 3 AS dataset, 'v' || o_custkey % 2 AS variant, 'p' || o_orderkey % 4 AS phase, (o_orderkey % 100)::DOUBLE AS seconds FROM orders"
    query(f"SELECT dataset, variant, {', '.join(f'''coalesce(sum(seconds) FILTER (phase = '{p}'), 0) AS {p}''' for p in ('p0', 'p1', 'p2', 'p3'))}, coalesce(sum(seconds), 0) AS total FROM ({timed}) GROUP BY 1, 2")(_named("timing_pivot", lambda s, sf: metrics.timing_table(_read(s, sf, "orders").select(F.concat(F.lit("d"), F.col("o_orderkey") % 3).alias("dataset"), F.concat(F.lit("v"), F.col("o_custkey") % 2).alias("variant"), F.concat(F.lit("p"), F.col("o_orderkey") % 4).alias("phase"), (F.col("o_orderkey") % 100).cast("double").alias("seconds")), ["p0", "p1", "p2", "p3"])))

    structure = "n_nodes, n_train, n_val, n_test, n_boundary, n_internal, size_bucket"
    over_communities(
        f"""{flagged}, m AS (SELECT community_id, id FROM misc UNION ALL SELECT DISTINCT c_src, dst FROM ends WHERE c_src <> c_dst), n AS (SELECT community_id, count(*) AS n_nodes FROM m GROUP BY 1)
        SELECT community_id, n_nodes, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'valid') AS n_val, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (is_boundary) AS n_boundary, count(*) FILTER (NOT is_boundary) AS n_internal,
        CASE WHEN n_nodes > 200 THEN 'large' WHEN n_nodes >= 50 THEN 'medium' ELSE 'small' END AS size_bucket FROM e JOIN n USING (community_id) GROUP BY community_id, n_nodes"""
    )(_named("sage_community_structure", lambda g, c: learn.train_communities(g, G.min_size(c, LEAST), CLASSES, hidden=4, epochs=1).select("community_id", *structure.split(", "))))
    over_communities(None)(_named("sage_community_metrics", lambda g, c: learn.train_communities(g, G.min_size(c, LEAST), CLASSES)))
    over_communities(None)(_named("sage_warm_probe_metrics", _warm))
    over_communities(
        f"""{_MAPPED}, {_SUPER}, {_LOCAL}, outside AS MATERIALIZED (SELECT DISTINCT l.community_id, dst AS id FROM local l LEFT JOIN mapped p ON dst = p.id WHERE dst <= -1000 OR p.community_id <> l.community_id),
        around AS MATERIALIZED (SELECT o.community_id, src_mapped AS src, dst_mapped AS dst FROM outside o JOIN super ON src_mapped = o.id LEFT JOIN outside q ON q.community_id = o.community_id AND q.id = dst_mapped WHERE dst_mapped <> -1000 - o.community_id AND (dst_mapped <= -1000 OR q.id IS NOT NULL)),
        small AS (SELECT id FROM mapped WHERE NOT is_major), sent AS MATERIALIZED (SELECT src_mapped AS src, dst_mapped AS dst FROM super WHERE src_mapped IN (SELECT id FROM small) AND (dst_mapped <= -1000 OR dst_mapped IN (SELECT id FROM small))), supers AS (SELECT DISTINCT dst AS id FROM sent WHERE dst <= -1000),
        n AS (SELECT community_id, id FROM mapped WHERE is_major UNION SELECT * FROM outside UNION SELECT community_id, dst FROM around UNION SELECT -1, id FROM small UNION SELECT -1, id FROM supers),
        e AS (SELECT * FROM local UNION SELECT * FROM around UNION SELECT -1, src, dst FROM sent UNION SELECT -1, src_mapped, dst_mapped FROM super WHERE src_mapped IN (SELECT id FROM supers) AND dst_mapped IN (SELECT id FROM supers))
        SELECT community_id, n_nodes, coalesce(n_edges, 0) AS n_edges FROM (SELECT community_id, count(*) AS n_nodes FROM n GROUP BY 1) LEFT JOIN (SELECT community_id, count(*) AS n_edges FROM e GROUP BY 1) USING (community_id)"""
    )(_named("super_graph_sizes", lambda g, c: learn.super_frame(g, c, LEAST).groupBy("community_id").agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum(F.greatest(F.size("neighbors"), F.lit(0)).cast("long")), F.lit(0)).alias("n_edges"))))
    over_communities(None)(_named("super_graph_metrics", lambda g, c: learn.train_frame(learn.super_frame(g, c, LEAST), CLASSES)))
    for model in ("gat", "transformer", "clusterscl"):
        over_communities(None)(_named(f"{model}_community_metrics", lambda g, c, model=model: learn.train_communities(g, G.min_size(c, LEAST, "drop"), CLASSES, epochs=10, model=model)))
    for model in ("sage", "gat", "gatv2", "transformer", "clusterscl", "arma", "asap"):
        over_graph(None)(_named(f"{model}_baseline", lambda g, model=model: learn.train_baseline(g, CLASSES, epochs=10, model=model)))
    over_graph(None)(_named("baseline_over_runs", lambda g: learn.over_runs(learn.baselines(g, CLASSES, [42, 43, 44], epochs=5), "comm_test_acc", "n_test")))
    over_graph(None)(_named("lpa_halves", lambda g: G.label_propagation_halves(g.nodes, g.edges)))
    over_graph(None)(_named("louvain_communities", lambda g: G.louvain(g.nodes, g.edges)))
    over_graph(None)(_named("leiden_communities", lambda g: G.louvain(g.nodes, g.edges, refine=True)))
    over_graph(None)(_named("kway_parts", lambda g: G.kway_parts(g.nodes, g.edges, 16, by=G.label_propagation(g.nodes, g.edges, 3))))
    held = f"{misc_ends}, l AS (SELECT c_src AS community_id, {spread_sql(42, 'src', 'dst')} % 1000 AS h FROM ends WHERE c_src = c_dst AND src < dst)"
    over_communities(f"{held} SELECT community_id, count(*) FILTER (h < 800) AS n_train, count(*) FILTER (h >= 800 AND h < 900) AS n_valid, count(*) FILTER (h >= 900) AS n_test FROM l GROUP BY 1")(_named("link_split_sizes", _link_sizes))
    over_communities(None)(_named("link_community_metrics", lambda g, c: learn.train_communities(g, G.min_size(c, LEAST), CLASSES, epochs=1, link_epochs=30, expand=False)))
    over_communities(None)(_named("sage_binned_metrics", lambda g, c: learn.train_communities(g, learn.split_misc(G.min_size(c, LEAST), 1000), CLASSES, epochs=10, per_bin=8)))
    over_graph(None)(_named("link_baseline", lambda g: learn.train_baseline(g, CLASSES, epochs=1, link_epochs=30, link_shares=(0.64, 0.16))))
    over_graph(None)(_named("sage_sampled_baseline", lambda g: learn.train_sampled(g, CLASSES, epochs=4)))
    over_communities(
        f"""{_COMM}, t AS (SELECT a.community_id AS cs, b.community_id AS cd FROM edges JOIN comm a ON src = a.id JOIN comm b ON dst = b.id), d AS (SELECT cs, count(*)::DOUBLE AS d, count(*) FILTER (cs = cd) AS i FROM t GROUP BY 1)
        SELECT round(sum(i) / sum(d) - sum(d * d) / sum(d) / sum(d), 6) AS modularity FROM d"""
    )(_named("lpa_modularity", lambda g, c: G.modularity(c, g.edges).select(F.round("modularity", 6).alias("modularity"))))
    query("SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS size FROM part UNION ALL SELECT s_suppkey, CAST(s_nationkey AS BIGINT) FROM supplier")(_named("table_roundtrip", _roundtrip))
    over_communities(
        f"""{flagged}, top AS (SELECT community_id, label, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT c_src AS community_id, count(*) AS n FROM ends WHERE c_src = c_dst GROUP BY 1)
        SELECT community_id, count(*) AS n_nodes, count(*) FILTER (is_boundary) AS n_boundary, coalesce(max(i.n), 0) AS n_intra_edges, round((SELECT max(n) FROM top WHERE top.community_id = e.community_id) / count(*), 6) AS majority_share
        FROM e LEFT JOIN i USING (community_id) GROUP BY community_id"""
    )(_named("community_summary", summary))


def _named(name: str, f):
    f.__name__ = name
    return f


def _warm(g: G.Graph, c: DataFrame) -> DataFrame:
    """Models that begin with the largest community's weights and keep its nodes near where they were; accuracy by a
    classifier on their embeddings."""
    kept = G.min_size(c, LEAST)
    start = learn.warm_start(g, kept, CLASSES)
    anchors = learn.warm_embeddings(g, kept, CLASSES, start) if start else None
    return learn.train_communities(g, kept, CLASSES, start=start, anchors=anchors, probe_epochs=20)


def _link_sizes(g: G.Graph, c: DataFrame) -> DataFrame:
    """How many of each community's undirected edges, each once, are trained on, kept for validation and tested on."""
    inside = G.intra_edges(g.edges, G.min_size(c, LEAST))
    split = G.link_split(inside.select("src", "dst")).join(inside, ["src", "dst"])
    n = lambda s: F.count(F.when(F.col("split") == s, 1)).alias(f"n_{s}")
    return split.groupBy("community_id").agg(n("train"), n("valid"), n("test"))


def predictions(nodes: DataFrame) -> DataFrame:
    """A fixed stand-in for a model: three labels in four are right, and scores have ties."""
    wrong = F.col("label") % 25 + 1
    return nodes.select("id", "label", F.when(spread(7, F.col("id")) % 4 != 0, F.col("label")).otherwise(wrong).alias("predicted"), (spread(9, F.col("id")) % 1000 + F.col("label") * 20).alias("score"))


def _evaluated(g: G.Graph, c: DataFrame) -> DataFrame:
    kept = G.min_size(c, LEAST)
    return predictions(g.nodes).join(kept, "id").join(G.boundary(g.edges, kept), "id").join(g.masks, "id", "left")


def _boundary_accuracy(g: G.Graph, c: DataFrame) -> DataFrame:
    test = F.col("split") == "test"
    return _evaluated(g, c).agg(F.round(metrics.accuracy("predicted", "label", test & F.col("is_boundary")), 6).alias("boundary_acc"), F.round(metrics.accuracy("predicted", "label", test & ~F.col("is_boundary")), 6).alias("internal_acc"))


def community_results(g: G.Graph, c: DataFrame) -> DataFrame:
    test = F.col("split") == "test"
    return _evaluated(g, c).groupBy("community_id").agg(F.count("*").alias("n_nodes"), F.count(F.when(test, 1)).alias("n_test"), metrics.accuracy("predicted", "label", test).alias("accuracy"))


def summary(g: G.Graph, c: DataFrame) -> DataFrame:
    """Of each community kept: nodes, boundary nodes, edges inside, and the share of its most frequent label."""
    kept = G.saved(G.min_size(c, LEAST), "kept")
    labels = kept.join(g.nodes.select("id", "label"), "id").groupBy("community_id", "label").agg(F.count("*").alias("n"))
    most = labels.groupBy("community_id").agg(F.max("n").alias("most"), F.sum("n").alias("n_nodes"))
    flags = G.boundary(g.edges, kept).join(kept, "id").groupBy("community_id").agg(F.sum(F.col("is_boundary").cast("long")).alias("n_boundary"))
    inside = G.intra_edges(g.edges, kept).groupBy("community_id").agg(F.count("*").alias("n_intra_edges"))
    out = most.join(flags, "community_id").join(inside, "community_id", "left")
    return out.select("community_id", "n_nodes", "n_boundary", F.coalesce("n_intra_edges", F.lit(0)).alias("n_intra_edges"), F.round(F.col("most") / F.col("n_nodes"), 6).alias("majority_share"))


def community_summary(spark: SparkSession, sf: str) -> DataFrame:
    return Q["community_summary"](spark, sf)


def _multi_hot(spark: SparkSession, sf: str) -> DataFrame:
    items = _read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_partkey") % 300).alias("item")).distinct()
    hot = graphs.multi_hot(items, 128)
    top = items.groupBy("item").count().orderBy(F.desc("count"), "item").limit(128).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "item"))), lambda s: s["item"]).alias("v"))
    ones = F.aggregate("features", F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    total = F.aggregate(F.zip_with("features", "v", lambda x, i: x.cast("long") * i), F.lit(0).cast("long"), lambda s, x: s + x)
    return hot.crossJoin(F.broadcast(top)).select("id", ones.alias("ones"), total.alias("item_sum"))


def _roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    store = TableStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.overwrite(_read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size")), "t", {"k": 1})
    store.append(_read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("size")), "t")
    store.compact("t", 4)
    store.vacuum("t")
    return store.read("t")


_add()
