"""Training of communities, of their graphs with super-nodes, and of whole graphs: one network each, by applyInArrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.core import LARGE_OVER, MEDIUM_FROM, MISC, SUPER_BASE, label_or_missing, spread, spread_of

from . import graph as G
from .graph import Graph, adjacency, boundary, ends
from .models import KINDS, Adam, Grown, LinkNetwork, Network, by_blocks, chunks, no_edges, room, trim
from .storage import TableStore, discard, saved

RESULT = (
    "community_id long, n_nodes long, n_edges long, n_train long, n_val long, n_test long, n_boundary long, n_internal long, "
    "comm_test_acc double, boundary_acc double, internal_acc double, comm_link_auc double, trained boolean, size_bucket string"
)
def rank_auc(scores: np.ndarray, positive: np.ndarray) -> float:
    if positive.all() or not positive.any():
        return 0.5
    order = pd.Series(scores).rank().to_numpy()
    p = int(positive.sum())
    return float((order[positive].sum() - p * (p + 1) / 2) / (p * (len(scores) - p)))


def training_frame(graph: Graph, communities: DataFrame, expand: bool = True) -> DataFrame:
    """(community_id, id, label, features, split, is_core, is_boundary, neighbors) of each community's members, with its halo if expanded.
    Features come last, so that they are shuffled with no other join."""
    members = communities.select("id", "community_id", F.lit(True).alias("is_core"))
    if expand:
        members = members.unionByName(G.halo(graph.edges, communities).withColumn("is_core", F.lit(False)))
    inside = ends(graph.edges, communities) if expand else ends(graph.edges, communities).where("c_src = c_dst")
    lists = inside.groupBy(F.col("c_src").alias("community_id"), F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))
    members = members.join(lists, ["community_id", "id"], "left").join(boundary(graph.edges, communities), "id", "left").join(graph.masks, "id", "left")
    return members.join(graph.nodes, "id").select("community_id", "id", "label", "features", "split", "is_core", "is_boundary", "neighbors")


class Probe:
    """A downstream classifier on embeddings: layers of 64 and 32 with ReLU, Adam in batches of 128. The weights with the
    best validation accuracy are kept; a later equal one doesn't replace them."""

    def __init__(self, width: int, classes: int, seed: int = 42):
        self.rng = np.random.default_rng(seed)
        sizes = (width, 64, 32, classes)
        self.w = [a for i, o in zip(sizes, sizes[1:], strict=False) for a in (self.rng.uniform(-1, 1, (i, o)) * np.sqrt(6 / (i + o)), np.zeros(o))]

    def layers(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for k in (0, 2):
            out.append(np.maximum(out[-1] @ self.w[k] + self.w[k + 1], 0))
        return [*out, out[-1] @ self.w[4] + self.w[5]]

    def gradient(self, x: np.ndarray, y: np.ndarray, decay: float = 5e-4) -> list[np.ndarray]:
        *acts, out = self.layers(x)
        g = np.exp(out - out.max(1, keepdims=True))
        g /= g.sum(1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        g /= len(y)
        grads: list[np.ndarray] = []
        for k in (4, 2, 0):
            act = acts[k // 2]
            grads = [act.T @ g + decay * self.w[k], g.sum(0) + decay * self.w[k + 1], *grads]
            g = (g @ self.w[k].T) * (act > 0)
        return grads

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.layers(x)[-1].argmax(1)

    def fit(self, x, y, train, valid, epochs: int, lr: float = 1e-3) -> None:
        m, v = ([np.zeros_like(a) for a in self.w] for _ in range(2))
        best, kept, t = -1.0, None, 0
        for _ in range(epochs):
            order = self.rng.permutation(train)
            for at in range(0, len(order), 128):
                rows, t = order[at : at + 128], t + 1
                for k, g in enumerate(self.gradient(x[rows], y[rows])):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            if len(valid) and (now := float((self.predict(x[valid]) == y[valid]).mean())) > best:
                best, kept = now, list(self.w)
        self.w = kept or self.w


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of lists, of which null ones have none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


class Rows:
    """Features at length 1, made so when asked for."""

    def __init__(self, x: np.ndarray, order: np.ndarray | None = None):
        self.x, self.order, self.shape = x, order, x.shape

    def __len__(self) -> int:
        return len(self.x)

    def __getitem__(self, rows) -> np.ndarray:
        x = np.asarray(self.x[rows if self.order is None else self.order[rows]], float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _columns(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """A group's columns by id: numbers as they are, `features` and an anchor as matrices, `neighbors` as values with their `ends`. Nulls
    are false, -1 or, in an anchor, rows that aren't among those `anchored`. No row is an object, so that a large group takes little more than its numbers."""
    got: dict[str, Grown] = {}
    put = lambda name, x: got.setdefault(name, Grown()).append(x)
    for batch in batches:
        for name in batch.schema.names:
            column = batch.column(name)
            if name == "features":
                values, lengths = _lists(column)
                if column.null_count or len(set(lengths.tolist())) > 1:
                    raise ValueError("all nodes must have features of one width")
                put(name, values.reshape(batch.num_rows, -1))
            elif name == "neighbors":
                values, lengths = _lists(column)
                put(name, values.astype(np.int64))
                put("lengths", lengths)
            elif name == "anchor":
                values, lengths = _lists(column)
                if len(values):
                    put(name, values.reshape(int((lengths > 0).sum()), -1))
                put("anchored", lengths > 0)
            elif name == "split":
                put(name, pc.fill_null(pc.index_in(column, pa.array(["train", "valid", "test"])), -1).to_numpy(zero_copy_only=False).astype(np.int8))
            else:
                put(name, (pc.fill_null(column, False) if pa.types.is_boolean(column.type) else column).to_numpy(zero_copy_only=False))
    out = {name: grown.array() for name, grown in got.items()}
    ids = out["id"]
    out["order"] = order = None if (ids[1:] > ids[:-1]).all() else np.argsort(ids, kind="stable")
    if order is not None:
        out |= {k: out[k][order] for k in out if k not in ("features", "neighbors", "lengths", "anchor", "anchored", "order")}
    return out


def _pairs(rows: dict[str, np.ndarray]) -> np.ndarray:
    """(source, target) of the edges among a community's rows, as numbers of rows by id, in order of source and list."""
    ids, order, lengths, to = rows["id"], rows["order"], rows["lengths"], rows["neighbors"]
    at = np.arange(len(ids), dtype=np.int32)
    if order is not None:
        at[order] = np.arange(len(ids), dtype=np.int32)
    out, done, source = room((len(to), 2), np.int32), 0, np.repeat(at, lengths)
    for part in chunks(len(to), 1 << 20):
        place = np.minimum(np.searchsorted(ids, to[part]), max(len(ids) - 1, 0))
        known = ids[place] == to[part]
        n = int(known.sum())
        out[done : done + n, 0], out[done : done + n, 1] = source[part][known], place[known]
        done += n
    out = out[:done]
    if order is None:
        return out
    by, sorted_ = np.argsort(out[:, 0], kind="stable"), room(out.shape, np.int32)
    for part in chunks(len(out), 1 << 20):
        sorted_[part] = out[by[part]]
    return sorted_


def _distinct(pairs: np.ndarray, n: int) -> np.ndarray:
    """Pairs of different ends of n, the smaller first, each once and sorted."""
    keys = np.unique(np.minimum(pairs[:, 0], pairs[:, 1]).astype(np.int64) * n + np.maximum(pairs[:, 0], pairs[:, 1])) if len(pairs) else np.zeros(0, np.int64)
    low = np.column_stack(np.divmod(keys, max(n, 1)))
    return low[low[:, 0] != low[:, 1]]


def link_parts(ids: np.ndarray, pairs: np.ndarray, seed: int, train: float = 0.8, valid: float = 0.1) -> dict[str, np.ndarray]:
    """A community's undirected edges, each once, dealt to train, valid and test by link_split()'s hash of their ends' ids."""
    low = _distinct(pairs, len(ids))
    h = spread_of(seed, ids[low[:, 0]], ids[low[:, 1]]) % 1000
    cut = round(1000 * train), round(1000 * (train + valid))
    return {"train": low[h < cut[0]], "valid": low[(h >= cut[0]) & (h < cut[1])], "test": low[h >= cut[1]]}


def fit_links(x: np.ndarray, ids: np.ndarray, pairs: np.ndarray, model: str, hidden: int, epochs: int, lr: float, seed: int, dropout: float = 0.0, train: float = 0.8, valid: float = 0.1, most_train: int | None = None, most_test: int | None = None) -> float:
    """ROC-AUC of held-out edges against as many pairs that are no edge, by a LinkNetwork whose messages pass over training edges
    only, both ways, and a loop on each node; 0.5 with fewer than five edges or none held out. At most `most_train` and `most_test` edges, None for all, in order of a seeded shuffle."""
    part, rng, n = link_parts(ids, pairs, seed, train, valid), np.random.default_rng(seed), len(x)
    if len(pairs) < 5 or not len(part["train"]) or not len(part["test"]):
        return 0.5
    edges, held = (p[rng.permutation(len(p))[:most]] for p, most in ((part["train"], most_train), (part["test"], most_test)))
    both = np.concatenate([edges, edges[:, ::-1], np.repeat(np.arange(n), 2).reshape(-1, 2)])
    a, b = pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)
    taken = np.unique(np.concatenate([a * n + b, b * n + a]))
    del a, b
    net = LinkNetwork(model, x.shape[1], hidden, seed, dropout)
    src, dst = by_blocks(x, both[:, 0], both[:, 1])
    x = x[np.arange(n)] if dst is not None else x
    del both
    net.fit_links(x, src, dst, edges, taken, epochs, lr)
    others = no_edges(rng, len(held), n, taken)
    scored = np.concatenate([held, others])
    return rank_auc(net.score(x, src, dst, scored), np.arange(len(scored)) < len(held))


def _arrays(rows, classes: int, seed: int, halo_in_test: bool, most_edges: int | None):
    """A community's rows, by id: (columns, pairs, features, labels, rows by split, message sources and targets, by target, generator).
    rows: a data frame, or batches of it."""
    if isinstance(rows, pd.DataFrame):
        rows = pa.Table.from_pandas(rows, preserve_index=False).to_batches()
    rows = _columns(rows)
    pairs, n = _pairs(rows), len(rows["id"])
    y, member = rows["label"], rows["is_core"].astype(bool) | halo_in_test
    part = {s: np.flatnonzero((rows["split"] == i) & member & (y >= 0) & (y < classes)) for i, s in enumerate(("train", "valid", "test"))}
    rng = np.random.default_rng(seed)
    kept = pairs[rng.permutation(len(pairs))[:most_edges]] if most_edges is not None and len(pairs) > most_edges else pairs
    keys = room((2 * len(kept) + n,), np.int64)
    for i, (a, b) in enumerate(((0, 1), (1, 0))):  # halo nodes send as well as receive
        for cut in chunks(len(kept), 1 << 20):
            keys[i * len(kept) + cut.start : i * len(kept) + cut.stop] = kept[cut, a].astype(np.int64) * n + kept[cut, b]
    keys[2 * len(kept) :] = np.arange(n) * (n + 1)
    keys.sort()
    src, dst, done, last = room((len(keys),), np.int32), room((len(keys),), np.int32), 0, -1
    for c in chunks(len(keys), 1 << 20):
        new = keys[c][np.diff(keys[c], prepend=last) != 0]
        dst[done : done + len(new)], src[done : done + len(new)] = np.divmod(new, max(n, 1))
        done, last = done + len(new), keys[c][-1]
    src, dst = src[:done], dst[:done]
    return rows, pairs, Rows(rows["features"], rows["order"]), y, part, src, dst, rng


def _graph_of(x: Rows, src: np.ndarray, dst: np.ndarray):
    """Features and messages as a network takes them: whole, or by blocks where the graph is large."""
    src, dst = by_blocks(x, src, dst)
    if dst is None:
        trim()
    return x if dst is None else x[np.arange(len(x))], src, dst


def _frame(graph: Graph, communities: DataFrame, expand: bool) -> DataFrame:
    return training_frame(graph, communities, expand).withColumn("label", label_or_missing(F.col("label")))


def _largest(graph: Graph, communities: DataFrame, expand: bool) -> DataFrame | None:
    """The training frame of the largest community, of equals that with the smallest id; None without communities."""
    largest = G.top_communities(G.community_sizes(communities), 1).collect()
    return _frame(graph, communities, expand).where(F.col("community_id") == largest[0].community_id) if largest else None


def warm_start(graph: Graph, communities: DataFrame, classes: int, hidden: int = 32, epochs: int = 5, lr: float = 0.01, seed: int = 42, expand: bool = True, model: str = "sage") -> dict[str, np.ndarray] | None:
    """The weights of a model trained on the largest community and all its edges, of equals that with the smallest id; None without communities.
    They are as large as one model, whatever the graph."""
    frame = _largest(graph, communities, expand)
    if frame is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, x, y, part, src, dst, _ = _arrays(batches, classes, seed, False, None)
        x, src, dst = _graph_of(x, src, dst)
        net = Network(model, x.shape[1], hidden, classes, seed)
        if len(part["train"]):
            net.fit(x, src, dst, y, part["train"], epochs, lr)
        yield pa.RecordBatch.from_pydict({"name": list(net.w), "shape": [list(w.shape) for w in net.w.values()], "x": [w.reshape(-1) for w in net.w.values()]})

    rows = frame.groupBy("community_id").applyInArrow(run, "name string, shape array<long>, x array<double>").collect()
    return {r.name: np.array(r.x).reshape(r.shape) for r in rows} if rows else None


def warm_embeddings(graph: Graph, communities: DataFrame, classes: int, start: dict[str, np.ndarray], seed: int = 42, expand: bool = True, model: str = "sage") -> DataFrame:
    """(id, embedding) of the largest community's members under the weights of warm_start(): a table, never on the driver."""
    frame, hidden = _largest(graph, communities, expand), len(start["head"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, _, x, _, _, src, dst, _ = _arrays(batches, classes, seed, False, None)
        x, src, dst = _graph_of(x, src, dst)
        net = Network(model, x.shape[1], hidden, classes, seed)
        net.w = start
        core, z = np.flatnonzero(rows["is_core"]), net.forward(x, src, dst)[0]
        for part in chunks(len(core)):
            at = core[part]
            yield pa.RecordBatch.from_arrays([pa.array(rows["id"][at]), pa.FixedSizeListArray.from_arrays(pa.array(z[at].reshape(-1)), z.shape[1]).cast(pa.list_(pa.float64()))], ["id", "embedding"])

    return frame.groupBy("community_id").applyInArrow(run, "id long, embedding array<double>")


def train_communities(
    graph: Graph, communities: DataFrame, classes: int, hidden: int = 32, epochs: int = 30, lr: float = 0.01, seed: int = 42, model: str = "sage", expand: bool = True,
    halo_in_test: bool = False, most_edges: int | None = None, start: dict[str, np.ndarray] | None = None, probe_epochs: int = 0, dropout: float = 0.0, anchors: DataFrame | None = None,
    link_epochs: int = 0, link_shares: tuple[float, float] = (0.8, 0.1), per_bin: int | None = None,
) -> DataFrame:
    """RESULT of each community: a model of its own, trained on its training nodes, and with link_epochs a second one that tells its edges from other pairs.

    An unknown model is an error. Halo nodes carry features but are neither trained nor tested on, unless halo_in_test.
    start: weights to begin with, of warm_start(). probe_epochs: over 0, accuracy is that of a Probe on the embedding.
    anchors: (id, embedding), of warm_embeddings(), that the embedding of these nodes is drawn to.
    Without training nodes a community has accuracy 0 and trained is false; without link_epochs, or with fewer than five edges, its link AUC is 0.5.
    link_shares: of the edges, each pair once, those trained on and kept for validation; the rest are tested on and pass no messages.
    With per_bin, some `per_bin` communities share a task's call, dealt by size as bins() does; else each has its own. A community trains
    in one task and must fit in its memory, as it is one model; min_size(), split_misc() and the choice of
    detector bound it. Message passing takes all edges, a large graph's block by block, and a loop on each node; at most `most_edges` in order of a seeded shuffle if a call gives it.
    """
    frame = _frame(graph, communities, expand)
    bins = G.bins(G.community_sizes(communities), per_bin).select("community_id", "bin_id") if per_bin else None
    return train_frame(frame, classes, hidden, epochs, lr, seed, model, halo_in_test, most_edges, start, probe_epochs, dropout, anchors, link_epochs, link_shares, bins)


def train_frame(
    frame: DataFrame, classes: int, hidden: int = 32, epochs: int = 30, lr: float = 0.01, seed: int = 42, model: str = "sage", halo_in_test: bool = False, most_edges: int | None = None,
    start: dict[str, np.ndarray] | None = None, probe_epochs: int = 0, dropout: float = 0.0, anchors: DataFrame | None = None,
    link_epochs: int = 0, link_shares: tuple[float, float] = (0.8, 0.1), bins: DataFrame | None = None,
) -> DataFrame:
    """train_communities() on rows like those of training_frame(), with all their edges. bins: (community_id, bin_id), where some communities share a call."""
    if model not in KINDS:
        raise ValueError(f"unknown model {model}: one of {', '.join(KINDS)}")
    anchored = anchors is not None
    if anchored:
        frame = frame.join(anchors.select("id", F.col("embedding").alias("anchor")), "id", "left")

    wanted = ["community_id", "id", "label", "features", "split", "is_core", "is_boundary", "neighbors"] + ["anchor"] * anchored
    frame = frame.select(*wanted)

    def train(batches: Iterator[pa.RecordBatch]) -> tuple:
        rows, pairs, x, y, part, src, dst, _ = _arrays(batches, classes, seed, halo_in_test, most_edges)
        core, edge, raw, n_pairs = rows["is_core"].astype(bool), rows["is_boundary"].astype(bool), x, len(pairs)
        pairs = pairs if link_epochs else None
        held_to = None
        if anchored and rows["anchored"].any():
            at = np.flatnonzero(rows["anchored"])
            if rows["order"] is not None:
                back = np.empty(len(raw), np.int64)
                back[rows["order"]] = np.arange(len(raw))
                at = back[at]
            held_to = at, rows["anchor"]
        x, src, dst = _graph_of(raw, src, dst)
        net, trained = Network(model, raw.shape[1], hidden, classes, seed, dropout), len(part["train"]) > 0
        if start is not None:
            net.w = {k: w.copy() for k, w in start.items()}
        if trained:
            net.fit(x, src, dst, y, part["train"], epochs, lr, held_to)
        emb, out = net.forward(x, src, dst)
        del src, dst
        if trained and probe_epochs:
            probe = Probe(emb.shape[1], classes, seed)
            probe.fit(emb, y, part["train"], part["valid"], probe_epochs)
            hit = np.concatenate([probe.predict(emb[c]) == y[c] for c in chunks(len(y))])
        else:
            hit = np.concatenate([out[c].argmax(1) == y[c] for c in chunks(len(y))])
        del emb, out
        rate = lambda rows: float(hit[rows].mean()) if trained and len(rows) else 0.0
        test, link = part["test"], 0.5
        if link_epochs:
            link = fit_links(raw, rows["id"], pairs, model, hidden, link_epochs, lr, seed, dropout, *link_shares, *((100_000, 20_000) if most_edges is not None else (None, None)))
        n, b = len(y), int((edge & core).sum())
        bucket = "large" if n > LARGE_OVER else "medium" if n >= MEDIUM_FROM else "small"
        return (int(rows["community_id"][0]), n, n_pairs, len(part["train"]), len(part["valid"]), len(test), b, int(core.sum()) - b, rate(test), rate(test[edge[test]]), rate(test[~edge[test]]), link, trained, bucket)

    names = [c.split()[0] for c in RESULT.split(", ")]
    told = lambda results: pa.RecordBatch.from_pydict({name: list(x) for name, x in zip(names, zip(*results, strict=True), strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield told([train(batches)])

    if bins is None:
        return frame.groupBy("community_id").applyInArrow(run, RESULT)

    def run_bin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        yield told([train(iter(rows.filter(pc.equal(rows["community_id"], c)).to_batches())) for c in sorted(set(rows["community_id"].to_pylist()))])

    return frame.join(bins, "community_id").groupBy("bin_id").applyInArrow(run_bin, RESULT)


def split_misc(communities: DataFrame, most_nodes: int) -> DataFrame:
    """Communities with MISC, where it has more than `most_nodes` nodes, dealt to MISC, MISC - 1 and so on by a hash of the node, so that no task holds them all."""
    parts = communities.where(F.col("community_id") == MISC).agg(F.greatest(F.ceil(F.count("*") / F.lit(most_nodes)), F.lit(1)).alias("_parts"))
    at = communities.crossJoin(F.broadcast(parts))
    return at.select("id", F.when(F.col("community_id") == MISC, F.lit(MISC) - spread(42, F.col("id")) % F.col("_parts")).otherwise(F.col("community_id")).cast("long").alias("community_id"))


def super_frame(graph: Graph, communities: DataFrame, least: int, most_nodes: int | None = None) -> DataFrame:
    """Rows like those of training_frame(): each major community's graph, and the minor nodes' as community MISC.

    A major community's graph has its nodes, the super-nodes and minor nodes next to them, and the super-nodes next to
    these: all that two layers see. Contracted edges join those outside of the community, its own super-node apart.
    The minor nodes' graph has all of them, with the super-nodes next to them; only if `most_nodes` is given and there are more,
    it falls into MISC, MISC - 1 and so on, by a hash of the node, and loses the edges between these. Only nodes with a split are trained and tested on.
    """
    at = saved(G.mapped(communities, least), "mapped")
    contracted = saved(G.contracted_edges(graph.edges, communities, least).toDF("src", "dst"), "contracted")
    local = saved(G.local_edges(graph.edges, communities, least), "local")
    members = at.where("is_major").select("community_id", "id", F.lit(True).alias("is_core"))
    outside = local.join(members.select("community_id", F.col("id").alias("dst")), ["community_id", "dst"], "left_anti").select("community_id", F.col("dst").alias("src")).distinct()
    outside = saved(outside, "outside")
    around = outside.join(contracted, "src").where(F.col("dst") != F.lit(SUPER_BASE) - F.col("community_id"))
    near = around.join(outside.withColumnRenamed("src", "dst"), ["community_id", "dst"], "left_semi")
    around = around.where(F.col("dst") <= SUPER_BASE).unionByName(near.where(F.col("dst") > SUPER_BASE))
    others = outside.select("community_id", F.col("src").alias("id")).unionByName(around.select("community_id", F.col("dst").alias("id"))).distinct()

    minor = at.where("not is_major").select("id")
    parts = max(1, -(-minor.count() // most_nodes)) if most_nodes else 1
    part = (F.lit(MISC) - F.pmod(F.xxhash64("id"), F.lit(parts))).cast("long")
    small = minor.select(part.alias("community_id"), "id", F.lit(True).alias("is_core"))
    sent = small.select("community_id", F.col("id").alias("src")).join(contracted, "src")
    within = sent.join(small.select("community_id", F.col("id").alias("dst")), ["community_id", "dst"], "left_semi")
    beside = sent.where(F.col("dst") <= SUPER_BASE)
    supers = beside.select("community_id", F.col("dst").alias("id")).distinct()
    among = supers.withColumnRenamed("id", "src").join(contracted.where((F.col("src") <= SUPER_BASE) & (F.col("dst") <= SUPER_BASE)), "src")
    among = among.join(supers.withColumnRenamed("id", "dst"), ["community_id", "dst"], "left_semi")

    listed = ["community_id", "src", "dst"]
    edges = local.select(listed)
    for e in (around, within, beside, among):
        edges = edges.unionByName(e.select(listed))
    lists = edges.groupBy("community_id", F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("neighbors"))
    placed = members.unionByName(small).unionByName(others.unionByName(supers).withColumn("is_core", F.lit(False)))
    means = G.centroids(graph, communities, least, "masked").select((F.lit(SUPER_BASE).cast("long") - F.col("community_id")).alias("id"), F.transform("features", lambda x: x.cast("float")).alias("features"))
    known = graph.nodes.select("id", "features", label_or_missing(F.col("label")).alias("label")).unionByName(means.withColumn("label", F.lit(-1)))
    flags = boundary(graph.edges, communities)
    placed = placed.join(lists, ["community_id", "id"], "left").join(flags, "id", "left").join(graph.masks, "id", "left")
    return placed.join(known, "id")  # features last, so that they are shuffled with no other join


def whole_graph(graph: Graph) -> DataFrame:
    """(id, community_id): all nodes as one community, whatever their number, for a baseline without communities."""
    return graph.nodes.select("id", F.lit(0).cast("long").alias("community_id"))


def train_baseline(graph: Graph, classes: int, **options) -> DataFrame:
    """train_communities() of the whole graph as one community with all its edges: one row, one model, in one task, which must hold the graph; train_sampled() needs none that does."""
    return train_communities(graph, whole_graph(graph), classes, most_edges=None, **options)


def baselines(graph: Graph, classes: int, seeds: list[int], **options) -> list[DataFrame]:
    """train_baseline() for each seed, from rows that are made once."""
    frame = saved(_frame(graph, whole_graph(graph), True), "frame")
    return [train_frame(frame, classes, seed=seed, most_edges=None, **options) for seed in seeds]


#: Seeds whose batches are written and shuffled together.
SEEDS_AT_ONCE = 1 << 16


def sampled_batches(graph: Graph, seeds: DataFrame, sampled: DataFrame, batch: int, seed: int) -> DataFrame:
    """(batch, id, is_seed, label, features, neighbors): for batches of some `batch` seeds (id), dealt by a hash, the nodes that two layers see
    over `sampled` edges, with the in-neighbours they hear. A batch's size is bounded by its seeds and the fanout."""
    return _batches(graph, deal(seeds, batch, seed), sampled)[0]


def deal(seeds: DataFrame, batch: int, seed: int) -> DataFrame:
    """(id, batch) of seeds, by a hash."""
    parts = seeds.agg(F.greatest(F.ceil(F.count("*") / F.lit(batch)), F.lit(1)).alias("_parts"))
    return saved(seeds.select("id").crossJoin(F.broadcast(parts)).select("id", (spread(seed, F.col("id")) % F.col("_parts")).alias("batch")), "seeds")


def _batches(graph: Graph, dealt: DataFrame, sampled: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of sampled_batches() for seeds with their batch, and the tables that they are read from."""
    heard = sampled.select(F.col("dst").alias("id"), "src")
    first = dealt.join(heard, "id").select("batch", F.col("src").alias("id"))
    hearers = saved(dealt.select("batch", "id").withColumn("_seed", F.lit(1)).unionByName(first.withColumn("_seed", F.lit(0))).groupBy("batch", "id").agg((F.max("_seed") == 1).alias("is_seed")), "hearers")
    lists = saved(hearers.join(heard, "id").groupBy("batch", "id").agg(F.collect_list("src").alias("neighbors")), "lists")
    outer = lists.select("batch", F.explode("neighbors").alias("id")).distinct().join(hearers, ["batch", "id"], "left_anti").withColumn("is_seed", F.lit(False))
    known = graph.nodes.select("id", "features", label_or_missing(F.col("label")).alias("label"))
    return hearers.select("batch", "id", "is_seed").unionByName(outer.select("batch", "id", "is_seed")).join(known, "id").join(lists, ["batch", "id"], "left"), [hearers, lists]


def _by_turns(graph: Graph, dealt: DataFrame, sampled: DataFrame, seeds: int, work: Callable[[DataFrame], DataFrame]) -> list:
    """The rows that `work` makes of all batches, some SEEDS_AT_ONCE seeds' at a time, so that the disk holds no more than theirs: tables and files of shuffles go after each turn."""
    spark, out, turns = dealt.sparkSession, [], max(1, -(-seeds // SEEDS_AT_ONCE))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        for turn in range(turns):
            rows, tables = _batches(graph, dealt.where(F.pmod(F.xxhash64("batch"), F.lit(turns)) == turn), sampled)
            out += work(rows).collect()
            for table in tables:
                discard(table)
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
    return out


def _batch_arrays(batches: Iterator[pa.RecordBatch]):
    rows = _columns(batches)
    pairs, x = _pairs(rows), Rows(rows["features"], rows["order"])
    loops = np.arange(len(x))
    dst, src = np.concatenate([pairs[:, 0], loops]), np.concatenate([pairs[:, 1], loops])
    order = np.argsort(dst, kind="stable")
    return rows, *_graph_of(x, src[order], dst[order]), rows["label"], np.flatnonzero(rows["is_seed"])


def _batch_gradient(weights: dict[str, np.ndarray], model: str, hidden: int, classes: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x, src, dst, y, rows = _batch_arrays(batches)
        net = Network(model, x.shape[1], hidden, classes, seed)
        net.w = weights
        grad = net.loss(x, src, dst, y, rows)[1]
        yield pa.RecordBatch.from_pydict({"name": list(grad), "n": [float(len(rows))] * len(grad), "g": [(g * len(rows)).reshape(-1) for g in grad.values()]})

    return run


def train_sampled(graph: Graph, classes: int, hidden: int = 32, epochs: int = 10, steps: int = 2, batch: int = 1024, fanout: int = 10, lr: float = 0.01, seed: int = 42, model: str = "sage") -> DataFrame:
    """One row (n_train, n_test, n_steps, test_acc): one model over a graph of any size. Each epoch draws `fanout` in-neighbours of every node anew and deals
    the training nodes to batches, whose gradients tasks compute; a step of Adam takes the mean over 1 / `steps` of the batches,
    added up before they reach the driver, which holds the model alone. Test nodes are told over sampled neighbours, too. No task holds the graph. The width of the features must be the same on all nodes."""
    known = graph.nodes.where(F.col("features").isNotNull()).withColumn("y", label_or_missing(F.col("label"))).where((F.col("y") >= 0) & (F.col("y") < classes))
    labelled = saved(graph.masks.join(known.select("id"), "id"), "labelled")
    train, test = (labelled.where(F.col("split") == s).select("id") for s in ("train", "test"))
    width = known.select(F.size("features").alias("n")).limit(1).collect()
    net = Network(model, width[0].n if width else 1, hidden, classes, seed)
    adam = Adam(net.w, lr)
    n_train, done = train.count(), 0
    for epoch in range(epochs if n_train else 0):
        sampled, dealt = saved(G.neighbor_sample(graph.edges, fanout, seed + epoch), "sampled"), deal(train, batch, seed + epoch)
        for step in range(steps):
            gradient = _batch_gradient(dict(net.w), model, hidden, classes, seed + epoch)

            def added(frame: DataFrame, gradient=gradient) -> DataFrame:
                part = frame.groupBy("batch").applyInArrow(gradient, "name string, n double, g array<double>")
                return part.groupBy("name").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))

            total = _by_turns(graph, dealt.where(F.col("batch") % steps == step), sampled, -(-n_train // steps), added)
            if total:
                names = {r.name for r in total}
                adam.step({k: sum(np.array(r.g) for r in total if r.name == k).reshape(net.w[k].shape) / sum(r.n for r in total if r.name == k) for k in sorted(names)})
                done += 1
        discard(sampled)
        discard(dealt)
    weights = dict(net.w)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, x, src, dst, y, rows = _batch_arrays(batches)
        own = Network(model, x.shape[1], hidden, classes, seed)
        own.w = weights
        yield pa.RecordBatch.from_pydict({"n": [len(rows)], "hit": [int((own.forward(x, src, dst)[1].argmax(1) == y)[rows].sum())]})

    sampled, dealt = saved(G.neighbor_sample(graph.edges, fanout, seed), "sampled"), deal(test, batch, seed)
    told = _by_turns(graph, dealt, sampled, dealt.count(), lambda frame: frame.groupBy("batch").applyInArrow(hits, "n long, hit long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hit")))
    n_test = sum(r.n for r in told)
    return graph.nodes.sparkSession.createDataFrame([(n_train, n_test, done, sum(r.hit for r in told) / n_test if n_test else 0.0)], "n_train long, n_test long, n_steps int, test_acc double")


def resumed(store: TableStore, name: str, frame: DataFrame, config: dict, train: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results `train` gives by community_id for `frame`, kept in the store: communities that have a result under the same
    configuration are not trained again; another configuration begins anew."""
    if store.exists(name, config):
        kept = store.read(name).select("community_id")
        rest = saved(frame.join(kept, "community_id", "left_anti"), "rest")
        return store.append(train(rest), name) if rest.limit(1).count() else store.read(name)
    return store.overwrite(train(frame), name, config)


def over_runs(results: list[DataFrame], value: str, weight: str) -> DataFrame:
    """One row: mean and population standard deviation over runs, such as seeds, of `value` weighted by `weight`."""
    from .metrics import weighted

    runs = [saved(r.agg(weighted(value, weight).alias("x")), "run") for r in results]  # one after the other: an executor has room for one large model
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.agg(F.count("*").alias("runs"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"))


def neighbor_lists(graph: Graph) -> DataFrame:
    return adjacency(graph.edges)
