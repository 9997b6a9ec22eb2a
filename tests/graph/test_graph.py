"""Hand graphs, properties and odd rows."""

import json
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftgraph.functions import core
from weftgraph.operators import graph as G
from weftgraph.operators import learn, metrics, models
from weftgraph.operators.storage import TableStore
from weftgraph.plans import catalog
from weftgraph.sources import graphs
from weftgraph.streaming import edges as streams

TOY = ([0, 1, 1, 2, 2, 0, 3, 3], [1, 0, 2, 1, 0, 2, 3, 4])
TRIANGLES = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]


def frame(spark, pairs):
    return spark.createDataFrame(pairs, graphs.EDGES)


def ids(spark, n):
    return spark.range(n).select("id", F.lit(0).alias("label"))


def pairs_of(df):
    return sorted((r[0], r[1]) for r in df.collect())


def test_toy(spark):
    nodes, edges = graphs.from_arrays(spark, np.array(TOY), n=5)
    r = G.validate(edges).first()
    assert (r.n_edges, r.n_self_loops, r.n_pairs, r.n_expected, r.is_clean) == (8, 1, 5, 10, False)
    clean = G.symmetrize(edges)
    assert pairs_of(clean) == sorted({(a, b) for a, b in zip(*TOY) if a != b} | {(b, a) for a, b in zip(*TOY) if a != b})
    assert G.validate(clean).first().is_clean and pairs_of(G.symmetrize(clean)) == pairs_of(clean)
    assert [r.id for r in G.isolated(nodes, clean).collect()] == []
    assert G.validate(edges.limit(0)).first().n_edges == 0 and G.symmetrize(edges.limit(0)).count() == 0


def lpa_brute(n, edges, rounds):
    c = list(range(n))
    for _ in range(rounds):
        after = list(c)
        for v in range(n):
            votes = {}
            for u, w in edges:
                if w == v:
                    votes[c[u]] = votes.get(c[u], 0) + 1
            if votes:
                after[v] = max((k, x) for x, k in votes.items())[1]
        c = after
    return c


@pytest.mark.parametrize("seed", [1, 2])
def test_label_propagation(spark, seed):
    random.seed(seed)
    edges = {(a, b) for a, b in ((random.randrange(30), random.randrange(30)) for _ in range(60)) if a != b}
    both = sorted(edges | {(b, a) for a, b in edges})
    for rounds in (1, 3):
        got = dict(G.label_propagation(ids(spark, 32), frame(spark, both), rounds).collect())
        assert [got[i] for i in range(32)] == lpa_brute(32, both, rounds)


def test_two_triangles(spark):
    edges = G.symmetrize(frame(spark, TRIANGLES))
    c = spark.createDataFrame([(i, 0 if i < 3 else 3) for i in range(6)] + [(6, 6)], "id long, community_id long")
    g = G.Graph(ids(spark, 7).withColumn("features", F.array(F.lit(1.0).cast("float"))), edges, spark.createDataFrame([(i, "train") for i in range(5)], "id long, split string"))
    assert {r.id for r in G.boundary(edges, c).where("is_boundary").collect()} == {2, 3}
    assert G.boundary(edges, c, "as_run").where("is_boundary").count() == 0
    assert {r.id for r in G.boundary(edges, G.min_size(c.where("id != 3"), 3, "drop")).where("is_boundary").collect()} == {2}
    assert pairs_of(G.halo(edges, c)) == [(2, 3), (3, 0)]
    assert G.intra_edges(edges, c).count() == 12 and G.expanded_edges(edges, c).count() == 14
    assert G.expanded_nodes(g, c).count() == 9 and G.min_size(c, 3).where("community_id = -1").count() == 1
    assert pairs_of(G.contracted_edges(edges, c, 3)) == [(-1003, -1000), (-1000, -1003)]
    assert [tuple(r) for r in G.local_stats(g, c, 3).orderBy("community_id").collect()] == [(0, 3, 7, 1, 0), (3, 3, 7, 1, 0)]
    assert abs(G.modularity(c, edges).first()[0] - (12 / 14 - 0.5)) < 1e-9
    assert {frozenset(r.id for r in x) for x in _groups(G.louvain(g.nodes, edges))} == {frozenset({0, 1, 2}), frozenset({3, 4, 5}), frozenset({6})}
    for f in (lambda: G.min_size(c, 3, "x"), lambda: G.boundary(edges, c, "x"), lambda: G.centroids(g, c, 3, "x")):
        with pytest.raises(ValueError):
            f()


def _groups(c):
    out = {}
    for r in c.collect():
        out.setdefault(r.community_id, []).append(r)
    return out.values()


def test_parts_and_splits(spark):
    sizes = [r[1] for r in G.balanced_parts(ids(spark, 103), 8).groupBy("community_id").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    counts = dict(G.random_split(ids(spark, 1000)).groupBy("split").count().collect())
    assert counts == {"train": 600, "valid": 200, "test": 200}


def test_nmi_and_auc(spark):
    c = spark.createDataFrame([(i, i % 4) for i in range(40)], "id long, community_id long")
    assert G.nmi(c, c.select("id", F.col("community_id").alias("label"))).first()[0] == 1.0
    assert G.nmi(c, c.select("id", F.lit(1).alias("label"))).first()[0] == 0.0
    random.seed(3)
    rows = [(random.randrange(6), random.random() < 0.4) for _ in range(200)]
    want = sum(1.0 if a > b else 0.5 if a == b else 0 for a, p in rows if p for b, q in rows if not q) / sum(p for _, p in rows) / sum(not p for _, p in rows)
    df = spark.createDataFrame(rows, "score int, positive boolean")
    assert abs(metrics.auc(df).first()[0] - want) < 1e-6
    assert metrics.auc(df.where("positive")).first()[0] == 0.5 and abs(learn.rank_auc(np.array([a for a, _ in rows]), np.array([p for _, p in rows])) - want) < 1e-9


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(core.l2_normalize(F.col("a")), core.dot(F.col("a"), F.col("b")), core.l2_normalize(F.col("z"))).first()
    assert [round(x, 6) for x in r[0]] == [0.6, 0.8] and r[1] == 11.0 and r[2] == [0.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double").select(core.label_or_missing(F.col("x"))).collect()]
    assert got == [1, -1, -1]


@pytest.mark.parametrize("kind", models.KINDS)
def test_gradient(kind):
    rng = np.random.default_rng(0)
    net, x = models.Network(kind, 4, 8, 3), rng.normal(size=(9, 4))
    src, dst = np.array([0, 1, 2, 3, 4, 5, 0, 8, 7]), np.array([1, 2, 0, 4, 5, 3, 3, 1, 1])
    y, rows, anchor = np.array([0, 1, 0, 1, 0, 1, 2, 2, 2]), np.array([0, 1, 3, 4, 6, 7]), (np.array([1, 2]), np.ones((2, 8)))
    net.w = {k: w + rng.normal(0, 0.1, w.shape) for k, w in net.w.items()}
    _, grad = net.loss(x, src, dst, y, rows, anchor=anchor)
    for k, w in net.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape)
            old = w[at]
            w[at] = old + 1e-6
            up, _ = net.loss(x, src, dst, y, rows, anchor=anchor)
            w[at] = old - 1e-6
            down, _ = net.loss(x, src, dst, y, rows, anchor=anchor)
            w[at] = old
            assert abs((up - down) / 2e-6 - grad[k][at]) < 1e-5


def _block_graph(monkeypatch, n=60):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(models, "BLOCK", 16)
    monkeypatch.setattr(models, "IN_FILE", 256)
    pairs = np.unique(np.concatenate([rng.integers(0, n, (150, 2)), np.repeat(np.arange(n), 2).reshape(-1, 2)]), axis=0)
    return rng, rng.normal(size=(n, 5)), pairs[:, 0], pairs[:, 1]


@pytest.mark.parametrize("dropout", [0.0, 0.3])
@pytest.mark.parametrize("kind", models.KINDS)
def test_blocks_give_what_the_whole_gives(kind, dropout, monkeypatch):
    rng, x, src, dst = _block_graph(monkeypatch)
    y, rows, anchor = rng.integers(0, 3, 60), np.arange(0, 60, 2), (np.array([1, 40]), np.ones((2, 8)))
    blocks, none = models.by_blocks(x, src, dst)
    assert none is None and len(list(blocks)) > 5 and sum(b - a for a, b, *_ in blocks) == 60
    nets = [models.Network(kind, 5, 8, 3, 1, dropout) for _ in range(2)]
    (one, g), (two, h) = nets[0].loss(x, src, dst, y, rows, anchor=anchor), nets[1].loss(x, blocks, None, y, rows, anchor=anchor)
    assert abs(one - two) < 1e-9 and all(np.allclose(g[k], h[k]) for k in g) and set(g) == set(h)
    assert all(np.allclose(a, b) for a, b in zip(nets[0].forward(x, src, dst), nets[1].forward(x, blocks), strict=True))
    pairs = [models.LinkNetwork(kind, 5, 8, 1, dropout) for _ in range(2)]
    (one, g), (two, h) = (n.link_loss(x, *at, np.array([(0, 9), (30, 59)]), np.array([(3, 9), (31, 59)])) for n, at in zip(pairs, ((src, dst), (blocks, None)), strict=True))
    assert abs(one - two) < 1e-9 and all(np.allclose(g[k], h[k]) for k in g)


def test_blocks_side_by_side():
    """In order, and no more of them are held than are computed at a time, and one."""
    taken, most = [], 0
    for i, x in enumerate(models.side_by_side(lambda i: i * i, (taken.append(k) or k for k in range(50)))):
        most = max(most, len(taken) - i)
        assert x == i * i
    assert i == 49 and most <= models.THREADS + 1
    with pytest.raises(ZeroDivisionError):
        list(models.side_by_side(lambda i: 1 // i, range(3)))


def test_pairs_lie_in_a_file(monkeypatch):
    """A large graph's edges take no memory, either, when its rows arrive in another order than that of their ids."""
    monkeypatch.setattr(models, "IN_FILE", 256)
    rows = {"id": np.arange(100), "order": np.arange(100)[::-1].copy(), "lengths": np.full(100, 2), "neighbors": np.tile([3, 500, 7, 8], 50)}
    got = learn._pairs(rows)
    assert isinstance(got, np.memmap) or isinstance(got.base, np.memmap)
    assert sorted(map(tuple, got.tolist())) == sorted((99 - r, x) for r in range(100) for x in ((3,), (7, 8))[r % 2]) and (np.diff(got[:, 0]) >= 0).all()


def test_no_tape_holds_the_graph(monkeypatch):
    """Of a graph by blocks, no array on the tape is larger than a block and what it hears; nor does the contrastive loss keep its batches."""
    rng, x, src, dst = _block_graph(monkeypatch, 2000)
    made, begin = [], models.Value.__init__
    monkeypatch.setattr(models.Value, "__init__", lambda self, v, *a, **o: begin(self, v, *a, **o) or made.append(len(self.x) if self.x.ndim else 1))
    net = models.Network("gatv2", 5, 8, 3, 1)
    net.fit(x, *models.by_blocks(x, src, dst), rng.integers(0, 3, 2000), np.arange(10), 1, 0.1)
    assert max(made) < 100


def test_a_group_is_read_in_any_order():
    rows = {"community_id": [0] * 4, "id": [7, 3, 9, 1], "label": [0, 1, 0, 1], "features": [[3.0, 4.0], [1.0, 0.0], [0.0, 2.0], [0.0, 0.0]], "split": ["train", None, "test", "valid"], "is_core": [True] * 4, "is_boundary": [None, True, False, True], "neighbors": [[3, 9, 50], [7], None, []]}
    table = pd.DataFrame(rows)
    got, pairs, x, y, part, src, dst, _ = learn._arrays(table, 2, 42, False, None)
    assert got["id"].tolist() == [1, 3, 7, 9] and y.tolist() == [1, 1, 0, 0] and pairs.tolist() == [[1, 2], [2, 1], [2, 3]]
    assert {k: v.tolist() for k, v in part.items()} == {"train": [2], "valid": [0], "test": [3]} and np.allclose(x[np.arange(4)], [[0, 0], [1, 0], [0.6, 0.8], [0, 1]])
    assert set(zip(src.tolist(), dst.tolist(), strict=True)) == {(i, i) for i in range(4)} | {(1, 2), (2, 1), (2, 3), (3, 2)} and got["is_boundary"].tolist() == [True, True, False, False]


def test_layers_by_hand():
    """Each layer on one node with two in-neighbours, against sums written out."""
    rng = np.random.default_rng(5)
    x, src, dst = rng.normal(size=(3, 2)), np.array([1, 2]), np.array([0, 0])
    soft = lambda s: np.exp(s) / np.exp(s).sum()
    slope = lambda v: np.where(v > 0, v, 0.2 * v)
    for layer in (models.Sage, models.Gat, models.Gatv2, models.Transformer, models.Arma, models.Le):
        one = layer(2, 3)
        w = {k: rng.normal(size=s) for k, s in one.shapes.items()}
        got = one({k: models.Value(v) for k, v in w.items()}, models.Value(x), src, dst).x[0]
        if layer is models.Sage:
            want = x[0] @ w["a"] + (x[1] + x[2]) / 2 @ w["b"] + w["bias"]
        elif layer is models.Gat:
            h = x @ w["a"]
            want = soft(np.array([slope(h[j] @ w["from"][0, 0] + h[0] @ w["to"][0, 0]) for j in range(3)])) @ h + w["bias"]
        elif layer is models.Gatv2:
            left, right = x @ w["l"] + w["l0"], x @ w["r"] + w["r0"]
            want = soft(np.array([slope(left[j] + right[0]) @ w["att"][0, 0] for j in range(3)])) @ left + w["bias"]
        elif layer is models.Transformer:
            q, k, v = (x @ w[c] + w[c + "0"] for c in "qkv")
            want = soft(np.array([q[0] @ k[j] / np.sqrt(3) for j in (1, 2)])) @ v[1:] + x[0] @ w["s"] + w["s0"]
        elif layer is models.Arma:
            h = x @ w["a"]
            want = np.maximum(h[0] / 3 + (h[1] + h[2]) / np.sqrt(3) + x[0] @ w["v"] + w["bias"], 0)
        else:
            a, b = x @ w["a"] + w["a0"], x @ w["b"]
            want = a.sum(0) - 3 * b[0] + x[0] @ w["c"] + w["c0"]
        assert np.allclose(got, want), layer


def test_contrast_by_brute_force():
    rng = np.random.default_rng(6)
    z, c, y = rng.normal(size=(6, 4)), rng.uniform(size=(4, 2)), np.array([0, 0, 1, 1, 0, 2])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    total = 0.0
    for i in range(6):
        pi = np.exp(z[i] @ c / models.KAPPA) / np.exp(z[i] @ c / models.KAPPA).sum()
        total += models.ETA * (pi * np.log(pi)).sum() / 6
        likely = np.zeros(6)
        for k in range(2):
            gate = 1 / (1 + np.exp(z[i] @ z.T - z[i] @ c[:, k]))
            s = np.exp((gate * (z[i] @ c[:, k]) + (1 - gate) * (z[i] @ z.T)) / models.TAU)
            likely += pi[k] * s / (s.sum() - s[i])
        same = [j for j in range(6) if j != i and y[j] == y[i]]
        total -= sum(np.log(likely[j]) for j in same) / max(len(same), 1) / 6
    assert abs(models.contrast(models.Value(z), models.Value(c), y).x - total) < 1e-9


def test_contrast_keeps_no_tables(monkeypatch):
    """A batch's tables of clusters and pairs are not on the tape; its gradient, with copies and over several groups of clusters, is that of differences."""
    made, begin, rng = [], models.Value.__init__, np.random.default_rng(8)
    z, c, y = rng.normal(size=(12, 4)), rng.uniform(size=(4, 9)), rng.integers(0, 3, 12)
    loss = lambda: float(models.contrast(models.Value(z), models.Value(c), y, 2).x)
    monkeypatch.setattr(models.Value, "__init__", lambda self, v, *a, **o: begin(self, v, *a, **o) or made.append(self.x.size))
    views, clusters = models.Value(z), models.Value(c)
    models.contrast(views, clusters, y, 2).backward()
    assert max(made) <= 144
    for x, g in ((z, views.grad), (c, clusters.grad)):
        for at in np.ndindex(x.shape):
            was, side = x[at], []
            for h in (1e-6, -1e-6):
                x[at] = was + h
                side.append(loss())
            x[at] = was
            assert abs((side[0] - side[1]) / 2e-6 - g[at]) < 1e-5


def test_training(spark):
    rng = np.random.default_rng(1)
    n = 120
    label = np.arange(n) % 3
    x = np.eye(3)[label] + rng.normal(0, 0.6, (n, 3))
    pairs = [(a, b) for a, b in rng.integers(0, n, (900, 2)) if a != b and (label[a] == label[b] or rng.random() < 0.05)]
    nodes, edges = graphs.from_arrays(spark, np.array(pairs).T, features=x, labels=label)
    g = G.Graph(nodes, G.symmetrize(edges), G.random_split(nodes))
    c = nodes.select("id", (F.col("id") % 2).alias("community_id"))
    got = learn.train_communities(g, c, 3, epochs=60).collect()
    assert len(got) == 2 and all(r.trained and r.comm_test_acc > 0.6 and 0 <= r.comm_link_auc <= 1 for r in got)
    assert [tuple(r) for r in learn.train_communities(g, c, 3, epochs=60).collect()] == [tuple(r) for r in got]
    alone = learn.train_communities(G.Graph(nodes, g.edges, g.masks.limit(0)), c, 3, epochs=2).first()
    assert not alone.trained and alone.comm_test_acc == 0.0
    with pytest.raises(ValueError):
        learn.train_communities(g, c, 3, model="gcn")
    for model in models.KINDS:
        assert all(r.trained and r.comm_test_acc > 0.5 for r in learn.train_communities(g, c, 3, hidden=16, epochs=40, model=model, dropout=0.1).collect()), model
    whole = learn.train_communities(g, learn.whole_graph(g), 3, epochs=60).collect()
    assert len(whole) == 1 and whole[0].n_nodes == n and whole[0].comm_test_acc > 0.6
    runs = learn.over_runs([learn.train_communities(g, c, 3, epochs=5, seed=s) for s in (1, 2)], "comm_test_acc", "n_test").first()
    assert runs.runs == 2 and 0 <= runs.mean <= 1 and runs.std >= 0


def test_runs_in_turn_over_rows_made_once(spark, monkeypatch):
    made, save = [], learn.saved
    monkeypatch.setattr(learn, "saved", lambda df, name: made.append(name) or save(df, name))
    rng = np.random.default_rng(0)
    nodes, edges = graphs.from_arrays(spark, rng.integers(0, 40, (2, 90)), features=rng.normal(size=(40, 3)), labels=np.arange(40) % 2)
    g = G.Graph(nodes, G.symmetrize(edges), G.random_split(nodes))
    got = learn.over_runs(learn.baselines(g, 2, [1, 2], epochs=2), "comm_test_acc", "n_test").first()
    assert made == ["frame", "run", "run"]
    assert got == learn.over_runs([learn.train_baseline(g, 2, seed=s, epochs=2) for s in (1, 2)], "comm_test_acc", "n_test").first()


def super_brute(edges, community, least):
    """{community: (nodes, edges)} of the graphs with super-nodes, by sets."""
    size = {c: sum(v == c for v in community.values()) for c in community.values()}
    major = {c for c in size if size[c] >= least}
    at = {v: -1000 - c if c in major else v for v, c in community.items()}
    contracted = {(at[a], at[b]) for a, b in edges if at[a] != at[b]}
    out = {}
    for m in major:
        mine = {v for v, c in community.items() if c == m}
        own = {(a, b if b in mine else at[b]) for a, b in edges if a in mine}
        near = {b for _, b in own} - mine
        more = {(a, b) for a, b in contracted if a in near and b != -1000 - m and (b <= -1000 or b in near)}
        out[m] = mine | near | {b for _, b in more}, own | more
    small = {v for v, c in community.items() if c not in major}
    edge = {(a, b) for a, b in contracted if a in small and (b in small or b <= -1000)}
    supers = {b for _, b in edge if b <= -1000}
    out[-1] = small | supers, edge | {(a, b) for a, b in contracted if a in supers and b in supers}
    return out


def test_features_are_shuffled_with_no_other_join(spark):
    nodes, edges = graphs.from_arrays(spark, np.array([[0, 1], [1, 2]]), features=np.eye(3), labels=np.arange(3))
    g = G.Graph(nodes, G.symmetrize(edges), spark.createDataFrame([(0, "train")], "id long, split string"))
    communities = nodes.select("id", (F.col("id") % 2).alias("community_id"))

    def joins(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        return sum(joins(p) for p in below) + (plan.nodeName() == "Join" and "features#" in plan.output().toString())

    for frame in (learn.training_frame(g, communities), learn.training_frame(g, communities, expand=False)):
        assert joins(frame._jdf.queryExecution().optimizedPlan()) == 1


def test_rows_added_up_by_the_row():
    from weftgraph.operators.models import Added, Network, Value

    rng = np.random.default_rng(8)
    for to in (rng.integers(0, 9, 300), np.sort(rng.integers(0, 40, 300)), np.zeros(0, int)):
        x, take = rng.integers(-50, 50, (20, 3)).astype(float), rng.integers(0, 20, len(to))
        want = np.zeros((41, 3))
        np.add.at(want, to, x[take])
        assert (Added(to, 41, take)(x) == want).all() and (Added(to, 41)(x[take]) == want).all()
    net, x, src, dst = Network("sage", 3, 4, 2), rng.normal(size=(5, 3)), np.array([0, 1, 1]), np.array([1, 2, 3])
    layer = net.layers[0]
    first = layer.mean(Value(x, fixed=True), src, dst, True)
    assert layer.mean(Value(x, fixed=True), src, dst, True) is first  # rows that don't change are not added up again
    assert (layer.mean(Value(x + 1, fixed=True), src, dst, True).x != first.x).any() and (layer.mean(Value(x, fixed=True), dst, src, True).x != first.x).any()


def test_super_graphs(spark):
    rng = np.random.default_rng(4)
    n = 60
    community = {i: int(i) if i > 47 else i % 4 for i in range(n)}
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, n, (160, 2)) if a != b}
    pairs |= {(b, a) for a, b in pairs}
    label = np.array([community[i] % 3 for i in range(n)])
    nodes, _ = graphs.from_arrays(spark, np.array(sorted(pairs)).T, features=np.eye(3)[label], labels=label)
    g = G.Graph(nodes, frame(spark, sorted(pairs)), G.random_split(nodes))
    c = spark.createDataFrame(list(community.items()), "id long, community_id long")
    rows = learn.super_frame(g, c, 5).collect()
    want = super_brute(pairs, community, 5)
    got = {}
    for r in rows:
        seen = got.setdefault(r.community_id, (set(), set()))
        assert r.id not in seen[0]
        seen[0].add(r.id)
        seen[1].update((r.id, j) for j in r.neighbors or [])
        assert r.is_core == (r.id >= 0 and (community[r.id] == r.community_id or r.community_id < 0)) and (r.id >= 0) == (r.label >= 0)
    assert got == want
    results = learn.train_frame(learn.super_frame(g, c, 5), 3, epochs=30).collect()
    assert {r.community_id: r.n_nodes for r in results} == {k: len(v[0]) for k, v in want.items()} and all(r.trained for r in results)
    assert {r.community_id for r in learn.super_frame(g, c, 5, most_nodes=6).select("community_id").distinct().collect()} >= {-1, -2, 0, 1, 2, 3}
    assert learn.super_frame(g, c.limit(0), 5).count() == 0


def test_minor_nodes_are_one_graph(spark):
    """Over 100,000 of them too, with all their edges."""
    n = 100_100
    nodes = spark.range(n).select("id", F.lit(1).alias("label"), F.array(F.lit(1.0)).alias("features"))
    edges = G.symmetrize(spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    g = G.Graph(nodes, edges, nodes.select("id", F.lit("train").alias("split")))
    got = learn.super_frame(g, nodes.select("id", F.col("id").alias("community_id")), 10).groupBy("community_id").agg(F.count("*").alias("n"), F.sum(F.size("neighbors")).alias("e"))
    assert [tuple(r) for r in got.collect()] == [(-1, n, 2 * (n - 1))]


def test_warm_start_and_probe(spark):
    rng = np.random.default_rng(2)
    label = np.arange(90) % 3
    x = np.eye(3)[label] + rng.normal(0, 0.3, (90, 3))
    pairs = [(a, b) for a, b in rng.integers(0, 90, (400, 2)) if a != b and label[a] == label[b]]
    nodes, edges = graphs.from_arrays(spark, np.array(pairs).T, features=x, labels=label)
    g = G.Graph(nodes, G.symmetrize(edges), G.random_split(nodes))
    c = nodes.select("id", (F.col("id") % 3 % 2).alias("community_id"))
    start = learn.warm_start(g, c, 3, hidden=8)
    assert set(start) == set(models.Network("sage", 3, 8, 3).w) and start["0.a"].shape == (3, 8)
    got = learn.train_communities(g, c, 3, hidden=8, start=start, probe_epochs=40).collect()
    assert len(got) == 2 and all(r.trained and r.comm_test_acc > 0.6 for r in got)
    anchors = learn.warm_embeddings(g, c, 3, start)
    assert anchors.count() == 60 and all(len(r.embedding) == 8 for r in anchors.collect())
    drawn = learn.train_communities(g, c, 3, hidden=8, start=start, anchors=anchors).collect()
    assert len(drawn) == 2 and all(r.trained and r.comm_test_acc > 0.6 for r in drawn)
    assert learn.warm_start(g, c.limit(0), 3) is None


def test_probe_gradient():
    rng = np.random.default_rng(3)
    p, x, y = learn.Probe(5, 3), rng.normal(size=(7, 5)), rng.integers(0, 3, 7)

    def loss():
        out = p.layers(x)[-1]
        z = out - out.max(1, keepdims=True)
        return -(z[np.arange(7), y] - np.log(np.exp(z).sum(1))).mean() + 2.5e-4 * sum((p.w[k] ** 2).sum() for k in (0, 2, 4))

    for k, g in enumerate(p.gradient(x, y)):
        at = tuple(0 for _ in p.w[k].shape)
        old = p.w[k][at]
        p.w[k][at] = old + 1e-6
        up = loss()
        p.w[k][at] = old - 1e-6
        down = loss()
        p.w[k][at] = old
        assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def test_halves_settle_a_bipartite_graph(spark):
    star = G.symmetrize(frame(spark, [(0, i) for i in range(1, 6)]))
    got = dict(G.label_propagation_halves(ids(spark, 7), star, 4).collect())
    assert len({got[i] for i in range(6)}) == 1 and got[6] == 6
    assert got == dict(G.label_propagation_halves(ids(spark, 7), star, 4).collect())


def test_sources(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "e.csv.gz", "wt") as f:
        f.write("0,1\n1,2\n")
    (tmp_path / "h.csv").write_text("node_1,node_2\n0,1\n")
    (tmp_path / "t.csv").write_text("id,target\n0,2\n1,\n")
    (tmp_path / "f.json").write_text(json.dumps({"0": [5, 7], "1": [7], "2": []}))
    for s, text in (("a", "0\n"), ("b", "1\n"), ("c", "2\n")):
        (tmp_path / s).write_text(text)
    assert pairs_of(graphs.edges_csv(spark, str(tmp_path / "e.csv.gz"), partitions=2)) == [(0, 1), (1, 2)]
    assert pairs_of(graphs.edges_csv(spark, str(tmp_path / "h.csv"), header=True)) == [(0, 1)]
    assert [tuple(r) for r in graphs.targets_csv(spark, str(tmp_path / "t.csv")).orderBy("id").collect()] == [(0, 2), (1, None)]
    assert {r.id: r.split for r in graphs.split_csv(spark, *(str(tmp_path / s) for s in "abc")).collect()} == {0: "train", 1: "valid", 2: "test"}
    assert {r.id: r.features for r in graphs.multi_hot(graphs.item_sets_json(spark, str(tmp_path / "f.json")), 2).collect()} == {0: [1.0, 1.0], 1: [1.0, 0.0]}
    np.savez(tmp_path / "g.npz", **{"edge_index": np.array([[0], [1]]), "node-feat": np.ones((2, 3)), "node-label": np.array([1.0, np.nan])})
    a = graphs.numpy_arrays(spark, str(tmp_path / "g.npz"))
    nodes, edges = graphs.from_arrays(spark, a["edge_index"], features=a["node_feat"], labels=a["node_label"])
    assert [(r.id, r.label, len(r.features)) for r in nodes.orderBy("id").collect()] == [(0, 1, 3), (1, -1, 3)] and pairs_of(edges) == [(0, 1)]
    bare = spark.createDataFrame([(0, None, None)], graphs.NODES)
    assert tuple(graphs.fill_features(bare, 2).first()) == (0, 0, [1.0, 1.0])
    assert pairs_of(graphs.one_relation(spark.createDataFrame([(0, 1, "cites"), (1, 2, "has")], "src long, dst long, rel string"), "cites")) == [(0, 1)]


def test_store(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/store")
    assert not s.exists("t")
    with pytest.raises(FileNotFoundError):
        s.read("t")
    s.overwrite(spark.range(5), "t", {"least": 10})
    assert s.exists("t", {"least": 10}) and not s.exists("t", {"least": 11})
    assert s.append(spark.range(5, 8), "t").count() == 8 and s.compact("t", 1).count() == 8
    assert s.vacuum("t") == 2 and s.read("t").count() == 8 and s.exists("t", {"least": 10})
    s.save_state("timings", {"phase1": [["a", "lpa"], 1.5]})
    assert s.load_state("timings") == {"phase1": [["a", "lpa"], 1.5]} and s.load_state("none") is None


def test_stream(spark, tmp_path):
    frame(spark, TRIANGLES + [(9, 9)]).write.parquet(str(tmp_path / "in"))
    q = streams.degree_stream(streams.edge_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.id: r.degree for r in spark.table("degrees").collect()} == {0: 2, 1: 2, 2: 3, 3: 3, 4: 2, 5: 2}


def test_latex():
    assert metrics.latex([("a", 1)], ("x", "y")).count(r"\\") == 2


def test_baselines_are_one_model(spark, monkeypatch):
    """Over 10,000 nodes and 200,000 edges too: one row, of the whole graph, with all edges in message passing."""
    n = 10_500
    nodes, edges = graphs.from_arrays(spark, np.array([(i, (i + d) % n) for i in range(n) for d in range(1, 12)]).T, features=np.eye(2)[np.arange(n) % 2], labels=np.arange(n) % 2)
    g, most, train = G.Graph(nodes, G.symmetrize(edges), G.random_split(nodes)), [], learn.train_communities
    monkeypatch.setattr(catalog, "graph", lambda spark, sf: g)
    monkeypatch.setattr(learn, "train_communities", lambda *a, **o: most.append(o.get("most_edges", 200_000)) or train(*a, **o))
    rows = catalog.Q["sage_baseline"](spark, "").collect()
    assert [(r.n_nodes, r.n_edges) for r in rows] == [(n, 2 * 11 * n)] and most == [None]
    pdf = pd.DataFrame({"id": [0, 1, 2, 3], "neighbors": [[1, 2, 3], [2, 3], [3], []], "features": [[1.0, 0.0]] * 4, "label": [0] * 4, "is_core": [True] * 4, "split": ["train"] * 4})
    sent = lambda most: len(learn._arrays(pdf, 2, 42, False, most)[5])
    assert (sent(None), sent(2)) == (16, 8)


class _Here:
    """A frame whose function is run in this process, on one community of n nodes that all have edges to each other."""

    def __init__(self, n):
        ids = np.arange(n)
        rows = {"community_id": [0] * n, "id": ids, "label": ids % 2, "features": [[1.0, i / n] for i in range(n)], "split": ["train", "test"] * (n // 2), "is_core": [True] * n, "is_boundary": [False] * n, "neighbors": [np.delete(ids, i) for i in range(n)]}
        self.batches, self.ran = pa.Table.from_pandas(pd.DataFrame(rows)).to_batches(), []

    def select(self, *columns):
        return self

    groupBy = select  # noqa: N815

    def applyInArrow(self, run, schema):  # noqa: N802
        self.ran += run(iter(self.batches))
        return self

    def collect(self):
        return [Row(**r) for b in self.ran for r in b.to_pylist()]


def _messages(monkeypatch):
    """How many messages each community's training passes, as they are read."""
    seen, arrays = [], learn._arrays
    monkeypatch.setattr(learn, "_arrays", lambda *a: seen.append(len((out := arrays(*a))[5])) or out)
    return seen


def test_communities_pass_all_messages(monkeypatch):
    """Over 200,000 edges too, and their link prediction takes all of over 100,000 pairs."""
    here, seen, links, fit = _Here(500), _messages(monkeypatch), [], models.LinkNetwork.fit_links
    monkeypatch.setattr(learn, "_frame", lambda *a: here)
    monkeypatch.setattr(models.LinkNetwork, "fit_links", lambda self, x, src, dst, edges, *a: links.append(len(edges)) or fit(self, x, src, dst, edges, *a))
    got = learn.train_communities(None, None, 2, hidden=2, epochs=1, link_epochs=1, link_shares=(0.9, 0.05)).collect()
    assert [(r.n_nodes, r.n_edges, r.trained) for r in got] == [(500, 500 * 499, True)] and seen == [500 * 500]
    assert 110_000 < links[0] < 500 * 499 / 2


def test_a_warm_start_passes_all_messages(monkeypatch):
    """Over 200,000 edges too, where weights are found and where embeddings are made with them."""
    here, seen = _Here(500), _messages(monkeypatch)
    monkeypatch.setattr(learn, "_largest", lambda *a: here)
    start = learn.warm_start(None, None, 2, hidden=2, epochs=1)
    assert len(here.ran) and seen == [500 * 500]
    here.ran = []
    anchors = learn.warm_embeddings(None, None, 2, start).collect()
    assert len(anchors) == 500 and seen == [500 * 500] * 2


def test_rows_of_a_graph_pass_all_messages(monkeypatch):
    """Rows that are given, such as a super-graph's, over 200,000 edges too."""
    here, seen = _Here(500), _messages(monkeypatch)
    got = learn.train_frame(here, 2, hidden=2, epochs=1).collect()
    assert got[0].n_edges == 500 * 499 and seen == [500 * 500]


def _modularity(edges, c, w=None):
    m2 = 2 * len(edges)
    inside = 2 * sum(c[a] == c[b] for a, b in edges)
    degree = {}
    for a, b in edges:
        for x in (a, b):
            degree[c[x]] = degree.get(c[x], 0) + 1
    return inside / m2 - sum((d / m2) ** 2 for d in degree.values())


def _louvain_brute(n, edges):
    """Single moves, then merges of communities, until neither gains."""
    c = list(range(n))
    while True:
        best, was = _modularity(edges, c), list(c)
        for v in range(n):
            for x in {c[b] if a == v else c[a] for a, b in edges if v in (a, b)}:
                after = [*c[:v], x, *c[v + 1 :]]
                if (q := _modularity(edges, after)) > best + 1e-12:
                    c, best = after, q
        if c == was:
            for x, y in {(c[a], c[b]) for a, b in edges if c[a] != c[b]}:
                after = [x if z == y else z for z in c]
                if (q := _modularity(edges, after)) > best + 1e-12:
                    c, best = after, q
            if c == was:
                return best


def _blocks(seed, sizes, inside, outside):
    rng = random.Random(seed)
    of = [k for k, n in enumerate(sizes) for _ in range(n)]
    return len(of), [(a, b) for a in range(len(of)) for b in range(a) if rng.random() < (inside if of[a] == of[b] else outside)]


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_and_leiden_levels(spark, seed):
    n, pairs = _blocks(seed, [8, 8, 8, 8], 0.7, 0.06)
    edges = G.saved(G.symmetrize(frame(spark, pairs)), "e")
    want = _louvain_brute(n, pairs)
    for refine in (False, True):
        c = {r.id: r.community_id for r in G.louvain(ids(spark, n + 2), edges, refine=refine).collect()}
        assert len(c) == n + 2 and c[n] == n and all(c[v] <= v for v in c)
        assert _modularity(pairs, c) >= 0.98 * want
        reach = lambda x, c=c: _reached(next(v for v in c if c[v] == x), {v for v in c if c[v] == x}, pairs)
        assert not refine or all(len(reach(x)) == sum(y == x for y in c.values()) for x in set(c.values()))  # each is connected


@pytest.mark.parametrize("refine", [False, True])
def test_levels_in_arrays_are_those_of_plans(spark, refine, monkeypatch):
    """And take no job per round."""
    n, pairs = _blocks(5, [12, 9, 7, 10, 6], 0.6, 0.08)
    edges = G.saved(G.symmetrize(frame(spark, pairs)), "e")
    plans, asked = [], G.local_moves
    monkeypatch.setattr(G, "local_moves", lambda *a, **o: plans.append(1) or asked(*a, **o))
    arrays = dict(G.louvain(ids(spark, n + 1), edges, refine=refine).collect())
    assert not plans
    monkeypatch.setattr(G.moves, "MOST_EDGES", -1)
    assert dict(G.louvain(ids(spark, n + 1), edges, refine=refine).collect()) == arrays and plans


def _reached(start, members, pairs):
    seen, todo = {start}, [start]
    while todo:
        v = todo.pop()
        for a, b in pairs:
            for x, y in ((a, b), (b, a)):
                if x == v and y in members and y not in seen:
                    seen.add(y)
                    todo.append(y)
    return seen


def test_kway_moves_lower_the_cut(spark):
    n, pairs = _blocks(3, [20, 20, 20, 20], 0.5, 0.02)
    edges = G.saved(G.symmetrize(frame(spark, pairs)), "e")
    before, after = G.balanced_parts(ids(spark, n), 4), G.kway_parts(ids(spark, n), edges, 4, rounds=6)
    sizes = [r["count"] for r in after.groupBy("community_id").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == n and max(sizes) <= 21
    assert G.edge_cut(after, edges) < 0.8 * G.edge_cut(before, edges)


@pytest.mark.parametrize("kind", ["sage", "gat", "transformer", "clusterscl"])
def test_link_gradient(kind):
    rng = np.random.default_rng(5)
    net = models.LinkNetwork(kind, 4, 8, seed=1)
    x, edges, others = rng.normal(size=(6, 4)), np.array([(0, 1), (1, 2), (3, 4)]), np.array([(0, 3), (2, 5)])
    src, dst = np.array([0, 1, 1, 2, 3, 4]), np.array([1, 0, 2, 1, 4, 3])
    _, grad = net.link_loss(x, src, dst, edges, others)
    for k in net.w:
        for at in [tuple(rng.integers(0, d) for d in net.w[k].shape) for _ in range(3)]:
            was, h, side = net.w[k][at], 1e-5, []
            for step in (h, -h):
                net.w[k][at] = was + step
                side.append(net.link_loss(x, src, dst, edges, others)[0])
            net.w[k][at] = was
            assert abs((side[0] - side[1]) / (2 * h) - grad[k][at]) < 1e-5, k


def test_links_are_held_out(monkeypatch):
    """Test edges pass no messages, neither way; pairs drawn are no edges; the split is that of link_split()."""
    rng = np.random.default_rng(6)
    n, of = 80, np.arange(80) % 2
    pairs = np.array([(a, b) for a in range(n) for b in range(n) if a != b and of[a] == of[b] and (a + b) % 3 == 0])
    part = learn.link_parts(np.arange(n) * 7, pairs, 42)
    assert sum(map(len, part.values())) * 2 == len(pairs) and len(np.unique(np.concatenate(list(part.values())), axis=0)) * 2 == len(pairs)
    seen = []
    fit = models.LinkNetwork.fit_links
    monkeypatch.setattr(models.LinkNetwork, "fit_links", lambda self, x, src, dst, *a: seen.append(set(zip(src.tolist(), dst.tolist()))) or fit(self, x, src, dst, *a))
    x = np.eye(2)[of] + rng.normal(scale=0.1, size=(n, 2))
    auc = learn.fit_links(x, np.arange(n) * 7, pairs, "sage", 8, 60, 0.02, 42)
    for s in ("valid", "test"):
        assert not any((a, b) in seen[0] or (b, a) in seen[0] for a, b in part[s].tolist())
    assert all((a, b) in seen[0] and (b, a) in seen[0] for a, b in part["train"].tolist()) and auc > 0.7
    taken = np.unique(pairs[:, 0] * n + pairs[:, 1])
    drawn = models.no_edges(rng, 500, n, taken)
    assert len(drawn) == 500 and (drawn[:, 0] != drawn[:, 1]).all() and not np.isin(drawn[:, 0] * n + drawn[:, 1], taken).any()
    assert len(models.no_edges(rng, 5, 2, np.array([1, 2]))) == 0 and learn.fit_links(x, np.arange(n), pairs[:4], "sage", 8, 1, 0.1, 1) == 0.5


def test_link_split_in_arrays_and_frames(spark):
    n, pairs = _blocks(4, [30, 30], 0.4, 0.1)
    edges = G.symmetrize(frame(spark, pairs))
    want = {s: {(r.src, r.dst) for r in G.link_split(edges).where(F.col("split") == s).collect()} for s in ("train", "valid", "test")}
    got = learn.link_parts(np.arange(n), np.array(pairs), 42)
    assert {s: {tuple(x) for x in v.tolist()} for s, v in got.items()} == want and all(want.values())
    drawn = [(r.src, r.dst) for r in G.negative_samples(edges, ids(spark, n)).collect()]
    both = {(a, b) for p in pairs for a, b in (p, p[::-1])}
    assert len(set(drawn)) == len(drawn) > 50 and not both & set(drawn) and all(a != b for a, b in drawn) and max(b for _, b in drawn) >= n - 5


def _labelled(spark, n=120):
    of = np.arange(n) % 2
    rng = random.Random(8)
    pairs = [(a, rng.choice([b for b in range(n) if of[b] == of[a] and b != a])) for a in range(n) for _ in range(3)]
    nodes, edges = graphs.from_arrays(spark, np.array(pairs).T, features=np.eye(2)[of] + np.random.default_rng(1).normal(scale=0.3, size=(n, 2)), labels=of)
    return G.Graph(G.saved(nodes, "n"), G.saved(G.symmetrize(edges), "e"), G.saved(G.random_split(nodes), "m"))


def test_sampled_training(spark):
    g = _labelled(spark)
    r = learn.train_sampled(g, 2, hidden=8, epochs=6, steps=2, batch=16, fanout=3, lr=0.05).collect()
    assert len(r) == 1 and r[0].n_train == 72 and r[0].n_test == 24 and r[0].n_steps == 12 and r[0].test_acc > 0.85
    none = learn.train_sampled(G.Graph(g.nodes, g.edges, g.masks.limit(0)), 2, epochs=1).first()
    assert none.n_train == 0 and none.n_test == 0 and none.test_acc == 0


def test_sampled_training_by_turns(spark, monkeypatch):
    """Few seeds at a time give the same, and leave no table of theirs."""
    g, kept, gone, save, drop = _labelled(spark), [], [], learn.saved, learn.discard
    whole = learn.train_sampled(g, 2, hidden=8, epochs=2, batch=8, fanout=3).first()
    monkeypatch.setattr(learn, "saved", lambda df, name: kept.append(name) or save(df, name))
    monkeypatch.setattr(learn, "discard", lambda t: gone.append(1) or drop(t))
    monkeypatch.setattr(learn, "SEEDS_AT_ONCE", 20)
    assert learn.train_sampled(g, 2, hidden=8, epochs=2, batch=8, fanout=3).first() == whole
    assert kept.count("lists") == 2 * 2 * 2 + 2 and len(gone) == 2 * kept.count("lists") + 2 * 2


def test_bins_misc_and_resumed_training(spark, tmp_path):
    g = _labelled(spark)
    c = G.saved(g.nodes.select("id", F.when(F.col("id") < 40, core.MISC).otherwise(F.col("id") % 8).cast("long").alias("community_id")), "c")
    parts = learn.split_misc(c, 15)
    sizes = {r.community_id: r["count"] for r in parts.groupBy("community_id").count().collect()}
    assert {x for x in sizes if x < 0} == {-1, -2, -3} and sum(v for x, v in sizes.items() if x < 0) == 40 and sizes[0] == 10
    one, binned = (sorted(learn.train_communities(g, parts, 2, hidden=4, epochs=2, per_bin=b).collect()) for b in (None, 3))
    assert one == binned and len(one) == len(sizes)
    store, trained = TableStore(spark, f"file://{tmp_path}/store"), []
    frame_ = learn._frame(g, parts, True)
    train = lambda f: trained.append(f.select("community_id").distinct().count()) or learn.train_frame(f, 2, hidden=4, epochs=1)
    first = learn.resumed(store, "r", frame_.where("community_id < 4"), {"epochs": 1}, train).count()
    assert learn.resumed(store, "r", frame_, {"epochs": 1}, train).count() == len(sizes) and trained == [first, len(sizes) - first]
    assert learn.resumed(store, "r", frame_, {"epochs": 1}, train).count() == len(sizes) and len(trained) == 2
    assert learn.resumed(store, "r", frame_, {"epochs": 2}, train).count() == len(sizes) and trained[-1] == len(sizes)


def test_reports(spark):
    rows = [("d", "lpa", "sage", 10, 4, 0.5, 2, 8, 0.2, 0.9, 0.7), ("d", "lpa", "sage", 0, 6, 0.0, 0, 3, 0.6, 0.4, 0.5), ("d", "lpa", "gat", 5, 0, 0.8, 1, 0, 0.1, 0.3, 0.5)]
    results = spark.createDataFrame(rows, "dataset string, algorithm string, model_type string, n_test long, n_edges long, comm_test_acc double, n_boundary long, n_internal long, boundary_acc double, internal_acc double, comm_link_auc double")
    t = {r.model_type: r for r in metrics.accuracy_table(results).collect()}
    assert (t["sage"].weighted_comm_acc, t["sage"].mean_comm_acc, t["sage"].mean_boundary_acc, t["sage"].mean_internal_acc) == (0.5, 0.25, 0.2, 0.65)
    assert t["sage"].weighted_comm_link_auc == 0.58 and t["gat"].mean_internal_acc == 0.0 and t["gat"].weighted_comm_link_auc == 0.0
    base = spark.createDataFrame([("d", "sage", 0.75, 0.6, 3.0)], "dataset string, model_type string, test_acc double, link_auc double, seconds double")
    timings = spark.createDataFrame([("d", "lpa", None, "phase1", 1.0), ("d", "lpa", None, "phase2", 2.0), ("d", "lpa", "gat", "phase3", 4.0)], "dataset string, algorithm string, model_type string, phase string, seconds double")
    s = metrics.summary_table("x", results, base, timings)
    assert s.columns == metrics.SUMMARY and len(s.columns) == 21
    by = {r.model_type: r for r in s.collect()}
    assert (by["sage"].acc_gap, by["sage"].auc_gap, by["sage"].total_123_s, by["sage"].phase3_s) == (0.25, 0.02, 3.0, None)
    assert (by["gat"].acc_gap, by["gat"].baseline_s, by["gat"].total_123_s) == (None, None, 7.0)
    box = metrics.summary_box("x", s.collect())
    assert len({len(line) for line in box.split("\n")}) == 1 and "0.7500" in box and "7.0s" in box
    g = metrics.gaps(spark.createDataFrame([("d", "sage", 0.5, 0.6), ("d", "gat", 0.5, None)], "dataset string, model string, accuracy double, auc double"), spark.createDataFrame([("d", "sage", 0.7, None)], "dataset string, model string, accuracy double, auc double"))
    by = {r.model: r for r in g.collect()}
    assert abs(by["sage"].acc_gap - 0.2) < 1e-9 and by["sage"].auc_gap is None and by["gat"].acc_gap is None


def test_npy_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, y, e = rng.normal(size=(1000, 3)).astype(np.float32), np.where(np.arange(1000) % 7, np.arange(1000) % 5, np.nan), rng.integers(0, 1000, (4000, 2))
    for name, a in (("x", x), ("y", y), ("e", e)):
        np.save(tmp_path / f"{name}.npy", a)
    rows = graphs.npy_rows(spark, f"{tmp_path}/x.npy", per_task=64).orderBy("row").collect()
    assert len(rows) == 1000 and np.allclose([r.x for r in rows], x)
    nodes, edges = graphs.npy_graph(spark, f"file://{tmp_path}/e.npy", f"{tmp_path}/x.npy", f"{tmp_path}/y.npy")
    assert sorted((r.src, r.dst) for r in edges.collect()) == sorted(map(tuple, e.tolist()))
    assert {r.id: r.label for r in nodes.collect()} == {i: -1 if np.isnan(v) else int(v) for i, v in enumerate(y)}
    with pytest.raises(ValueError):
        np.save(tmp_path / "f.npy", np.asfortranarray(x))
        graphs.npy_rows(spark, f"{tmp_path}/f.npy")


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    s = TableStore(spark, f"file://{tmp_path}/store")
    s.overwrite(spark.range(5), "t")
    (tmp_path / "store" / "t" / "_next-left").write_text("cut off")
    s.overwrite(spark.range(9), "t")
    assert s.read("t").count() == 9
    monkeypatch.setattr(s, "_publish", lambda *a: (_ for _ in ()).throw(OSError()))
    with pytest.raises(OSError):
        s.overwrite(spark.range(2), "t")
    assert s.read("t").count() == 9 and s.vacuum("t") == 3 and s.read("t").count() == 9
