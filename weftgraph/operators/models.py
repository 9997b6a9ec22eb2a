"""Graph networks in numpy over a small tape of reverse-mode derivatives; each fits one community in one task, a large one block by block."""

from __future__ import annotations

import ctypes
import tempfile
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa

#: Targets and messages of a block, eight of which a graph must exceed to be taken by blocks; blocks that are computed at a time; bytes from which an array lies in a file.
BLOCK, THREADS, IN_FILE = 1 << 14, 2, 1 << 22


def room(shape: tuple[int, ...], dtype=float) -> np.ndarray:
    """Zeros; a large array lies in a file of the task's temporary folder that goes with it, so that the graph needn't fit in memory."""
    size = int(np.prod(shape)) * np.dtype(dtype).itemsize
    if size < IN_FILE:
        return np.zeros(shape, dtype)
    with tempfile.TemporaryFile() as f:
        f.truncate(size)
        return np.memmap(f, dtype, "r+", shape=tuple(shape))


def chunks(n: int, size: int = BLOCK) -> Iterator[slice]:
    return (slice(a, min(a + size, n)) for a in range(0, n, size))


def trim() -> None:
    """Memory that was freed goes back to the system: a task's arrays, once read, need little of what reading them took."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if free:
        free(0)


def side_by_side(work: Callable, items: Iterable) -> Iterator:
    """work(item) of each, in order, THREADS at a time and no more of them ahead than that."""
    with ThreadPoolExecutor(THREADS) as pool:
        ahead: deque = deque()
        for item in items:
            ahead.append(pool.submit(work, item))
            if len(ahead) > THREADS:
                yield ahead.popleft().result()
        while ahead:
            yield ahead.popleft().result()


class Grown:
    """An array that grows by batches; beyond IN_FILE bytes it lies in a file of the task's temporary folder that goes with it."""

    def __init__(self):
        self.parts, self.rows, self.size, self.file = [], 0, 0, None

    def append(self, x: np.ndarray) -> None:
        self.parts.append(np.array(x))
        self.rows, self.size = self.rows + len(x), self.size + x.nbytes
        if self.size > IN_FILE:
            self.file = self.file or tempfile.TemporaryFile()
            for part in self.parts:
                self.file.write(np.ascontiguousarray(part).data)
            self.parts, self.size, self.like = [], IN_FILE, x

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        for part in self.parts:
            self.file.write(np.ascontiguousarray(part).data)
        self.file.flush()
        self.parts = []
        return np.memmap(self.file, self.like.dtype, "r+", shape=(self.rows, *self.like.shape[1:]))


class Added:
    """Rows of an array, of which `take` names those meant (else each), added up by the row, of n, that each goes to, one after the other; made once for any number of arrays."""

    def __init__(self, to: np.ndarray, n: int, take: np.ndarray | None = None):
        self.n, self.hubs, self.steps = n, [], []
        if not len(to):
            return
        if (to[1:] < to[:-1]).any():
            order = np.argsort(to, kind="stable")
            to, take = to[order], order if take is None else take[order]
        at = lambda rows: rows if take is None else take[rows]
        starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        counts = np.diff(np.append(starts, len(to)))
        few = counts <= 32  # the first row of each, then the second of those that have one, and so on
        self.hubs = [(to[starts[i]], at(np.arange(starts[i], starts[i] + counts[i]))) for i in np.flatnonzero(~few)]
        starts, counts = starts[few], counts[few]
        order = np.argsort(-counts, kind="stable")
        starts, counts = starts[order], counts[order]
        if len(starts):
            self.to = to[starts]
            self.steps = [at(starts[:end] + k) for k, end in enumerate(np.searchsorted(-counts, -np.arange(counts[0]), "left"))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, *x.shape[1:]))
        for to, rows in self.hubs:
            out[to] = np.take(x, rows, axis=0).sum(0)
        if self.steps:
            total = np.take(x, self.steps[0], axis=0)
            for rows in self.steps[1:]:
                total[: len(rows)] += np.take(x, rows, axis=0)
            out[self.to] = total
        return out


def add_rows(x: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Rows of x added up by the row, of n, that each goes to."""
    return Added(to, n)(x)


class Value:
    """An array on the tape: what it was computed from, and how its gradient goes back to each of those. A fixed one, and what
    is made of fixed ones only, has no gradient."""

    def __init__(self, x, back: Sequence[tuple[Value, Callable[[np.ndarray], np.ndarray]]] = (), fixed: bool = False):
        self.x, self.grad, self.back = np.asarray(x, float), None, [b for b in back if not b[0].fixed]
        self.fixed = fixed or (bool(back) and not self.back)

    def __add__(self, o):
        o = o if isinstance(o, Value) else Value(o, fixed=True)
        return Value(self.x + o.x, [(self, lambda g: _like(g, self.x)), (o, lambda g: _like(g, o.x))])

    def __neg__(self):
        return Value(-self.x, [(self, lambda g: -g)])

    def __sub__(self, o):
        return self + (-o)

    def __mul__(self, o):
        o = o if isinstance(o, Value) else Value(o, fixed=True)
        return Value(self.x * o.x, [(self, lambda g: _like(g * o.x, self.x)), (o, lambda g: _like(g * self.x, o.x))])

    def __truediv__(self, o):
        o = o if isinstance(o, Value) else Value(o, fixed=True)
        return Value(self.x / o.x, [(self, lambda g: _like(g / o.x, self.x)), (o, lambda g: _like(-g * self.x / o.x**2, o.x))])

    def __matmul__(self, o):
        return Value(self.x @ o.x, [(self, lambda g: g @ o.x.T), (o, lambda g: self.x.T @ g)])

    def __getitem__(self, rows):
        return Value(np.take(self.x, rows, axis=0), [(self, lambda g: add_rows(g, rows, len(self.x)))])

    @property
    def T(self):
        return Value(self.x.T, [(self, lambda g: g.T)])

    def reshape(self, *shape):
        return Value(self.x.reshape(shape), [(self, lambda g: g.reshape(self.x.shape))])

    def sum(self, axis=None, keepdims=False):
        def back(g):
            return np.broadcast_to(g if keepdims or axis is None else np.expand_dims(g, axis), self.x.shape)

        return Value(self.x.sum(axis=axis, keepdims=keepdims), [(self, back)])

    def map(self, f, slope):
        """An elementwise function; `slope` is its derivative, of argument and result."""
        y = f(self.x)
        return Value(y, [(self, lambda g: g * slope(self.x, y))])

    def backward(self, grad: np.ndarray | None = None) -> None:
        """Gradients of this value, weighed by `grad`, for all it was computed from; those in between are let go."""
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            v, done = todo.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                todo.append((v, True))
                todo += [(p, False) for p, _ in v.back]
        self.grad = np.ones_like(self.x) if grad is None else grad
        for v in reversed(order):
            for p, f in v.back:
                g = f(v.grad)
                p.grad = g if p.grad is None else p.grad + g
            v.grad = None if v.back else v.grad


def _like(g: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A gradient summed over the axes along which its array was broadcast."""
    g = g.sum(axis=tuple(range(g.ndim - x.ndim))) if g.ndim > x.ndim else g
    wide = tuple(i for i, n in enumerate(x.shape) if n == 1 and g.shape[i] != 1)
    return g.sum(axis=wide, keepdims=True) if wide else g


def exp(v: Value) -> Value:
    return v.map(np.exp, lambda x, y: y)


def log(v: Value) -> Value:
    return v.map(lambda x: np.log(x + 1e-18), lambda x, y: 1 / (x + 1e-18))


def relu(v: Value) -> Value:
    return v.map(lambda x: np.maximum(x, 0), lambda x, y: x > 0)


def elu(v: Value) -> Value:
    return v.map(lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))), lambda x, y: np.where(x > 0, 1, y + 1))


def leaky(v: Value, slope: float = 0.2) -> Value:
    return v.map(lambda x: np.where(x > 0, x, slope * x), lambda x, y: np.where(x > 0, 1, slope))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def sigmoid(v: Value) -> Value:
    return v.map(_logistic, lambda x, y: y * (1 - y))


def softplus(v: Value) -> Value:
    return v.map(lambda x: np.logaddexp(0, x), lambda x, y: _logistic(x))


def gather_sum(v: Value, to: np.ndarray, n: int) -> Value:
    """Rows added up by the row, of n, that each goes to."""
    return Value(add_rows(v.x, to, n), [(v, lambda g: np.take(g, to, axis=0))])


def softmax_by(scores: Value, to: np.ndarray, n: int) -> Value:
    """Scores made to shares among the rows of the same target."""
    top = np.full((n, *scores.x.shape[1:]), -np.inf)
    if (to[1:] < to[:-1]).any():
        np.maximum.at(top, to, scores.x)
    elif len(to):
        starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        top[to[starts]] = np.maximum.reduceat(scores.x, starts, axis=0)
    e = exp(scores + -top[to])
    return e / gather_sum(e, to, n)[to]


def log_shares(logits: Value, keep: np.ndarray | None = None) -> Value:
    """Logarithms of the softmax over the last axis, among the places that `keep` marks."""
    z = logits + -logits.x.max(-1, keepdims=True)
    e = exp(z) if keep is None else exp(z) * keep
    return z - log(e.sum(axis=-1, keepdims=True))


def unit_rows(v: Value) -> Value:
    return v / (v * v).sum(axis=1, keepdims=True).map(lambda x: np.sqrt(x + 1e-24), lambda x, y: 0.5 / y)


# --- layers: weights by name, and what they make of (x, message sources, targets) -----------------------------------


def _loops(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges that are no loops, and a loop on each node, by target."""
    apart = src != dst
    if len(src) - apart.sum() == n and (np.bincount(src[~apart], minlength=n) == 1).all():
        return src, dst
    src, dst = np.concatenate([src[apart], np.arange(n)]), np.concatenate([dst[apart], np.arange(n)])
    order = np.argsort(dst, kind="stable")
    return src[order], dst[order]


class Blocks:
    """A graph's targets in runs of some BLOCK targets and messages, each with the nodes it hears: what one layer needs for these targets alone. A hub's messages lie in one block."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        if (dst[1:] < dst[:-1]).any():
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
        count = np.bincount(dst, minlength=n)
        ends = np.concatenate([[0], np.cumsum(count)])
        self.n, self.degree = n, np.bincount(dst[src != dst], minlength=n) + 1  # with one loop on each node
        self.cuts = np.concatenate([[0], np.flatnonzero(np.diff((ends[1:] + np.arange(n)) // BLOCK)) + 1, [n]]) if n else np.zeros(1, int)
        self.ends = ends[self.cuts]
        self.src, self.dst, self.near, self.at = room((len(src),), np.int32), room((len(src),), np.int32), [], [0]
        for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            here = slice(self.ends[i], self.ends[i + 1])
            s, outside = src[here], (src[here] < a) | (src[here] >= b)
            others = np.unique(s[outside])
            self.src[here] = np.where(outside, b - a + np.searchsorted(others, s), s - a)
            self.dst[here] = dst[here] - a
            self.near.append(others.astype(np.int32))

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first target, end, nodes: the targets and then the others they hear, message sources and targets among these, degrees)."""
        for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            here, nodes = slice(self.ends[i], self.ends[i + 1]), np.concatenate([np.arange(a, b), self.near[i]])
            yield int(a), int(b), nodes, np.array(self.src[here], np.int64), np.array(self.dst[here], np.int64), self.degree[nodes]


def by_blocks(x, src, dst):
    """(src, dst), or (Blocks, None) of a graph that is larger than a block."""
    return (Blocks(src, dst, len(x)), None) if len(x) + len(src) > 8 * BLOCK else (src, dst)


class Layer:
    shapes: dict[str, tuple[int, ...]]

    def __init__(self, width: int, out: int, heads: int = 1):
        self.width, self.out, self.heads, self.each = width, out, heads, out // heads
        if out % heads:
            raise ValueError(f"{heads} heads don't divide a width of {out}")
        self.shapes = self.weights()


class Sage(Layer):
    """x A + mean(in-neighbours) B; a node without any has a mean of zeros."""

    def weights(self):
        return {"a": (self.width, self.out), "b": (self.width, self.out), "bias": (self.out,)}

    kept: tuple = (None, None, None, None)

    def __call__(self, w, x, src, dst, degree=None):
        return x @ w["a"] + self.mean(x, src, dst, degree is None) @ w["b"] + w["bias"]

    def mean(self, x, src, dst, whole: bool):
        """The mean of what each node hears. Of a whole graph, the ways rows are added up are kept from one step to the next, and the mean of rows that don't change."""
        n, (of, targets, ways, fixed) = len(x.x), self.kept
        if not whole or of is not src or targets is not dst:
            ways, fixed = (Added(dst, n, src), Added(src, n, dst), np.maximum(np.bincount(dst, minlength=n), 1)[:, None]), None
        if fixed is None or not x.fixed or fixed[0] is not x.x:
            out = Value(ways[0](x.x), [(x, ways[1])]) / ways[2]
            fixed = (x.x, out) if x.fixed else fixed
        else:
            out = fixed[1]
        if whole:
            self.kept = src, dst, ways, fixed
        return out


class Gat(Layer):
    """Additive attention: a score for each end, summed, by head; every node also hears itself."""

    def weights(self):
        return {"a": (self.width, self.out), "from": (1, self.heads, self.each), "to": (1, self.heads, self.each), "bias": (self.out,)}

    def __call__(self, w, x, src, dst, degree=None):
        n = len(x.x)
        src, dst = _loops(src, dst, n)
        h = (x @ w["a"]).reshape(n, self.heads, self.each)
        scores = (h * w["from"]).sum(axis=2)[src] + (h * w["to"]).sum(axis=2)[dst]
        share = softmax_by(leaky(scores), dst, n).reshape(len(src), self.heads, 1)
        return gather_sum(h[src] * share, dst, n).reshape(n, self.out) + w["bias"]


class Gatv2(Layer):
    """Attention scored after the nonlinearity, so that its order of neighbours may differ by target."""

    def weights(self):
        return {"l": (self.width, self.out), "l0": (self.out,), "r": (self.width, self.out), "r0": (self.out,), "att": (1, self.heads, self.each), "bias": (self.out,)}

    def __call__(self, w, x, src, dst, degree=None):
        n = len(x.x)
        src, dst = _loops(src, dst, n)
        left, right = ((x @ w[k] + w[k + "0"]).reshape(n, self.heads, self.each) for k in ("l", "r"))
        scores = (leaky(left[src] + right[dst]) * w["att"]).sum(axis=2)
        share = softmax_by(scores, dst, n).reshape(len(src), self.heads, 1)
        return gather_sum(left[src] * share, dst, n).reshape(n, self.out) + w["bias"]


class Transformer(Layer):
    """Scaled products of queries and keys weigh the in-neighbours' values; a node's own part is added."""

    def weights(self):
        return {k: s for c in "qkvs" for k, s in ((c, (self.width, self.out)), (c + "0", (self.out,)))}

    def __call__(self, w, x, src, dst, degree=None):
        n = len(x.x)
        q, k, v = ((x @ w[c] + w[c + "0"]).reshape(n, self.heads, self.each) for c in "qkv")
        scores = (q[dst] * k[src]).sum(axis=2) * (1 / np.sqrt(self.each))
        share = softmax_by(scores, dst, n).reshape(len(src), self.heads, 1)
        return gather_sum(v[src] * share, dst, n).reshape(n, self.out) + x @ w["s"] + w["s0"]


class Arma(Layer):
    """One stack of one step: relu of neighbours, scaled by both ends' degrees, and a node's own part."""

    def weights(self):
        return {"a": (self.width, self.out), "v": (self.width, self.out), "bias": (self.out,)}

    def __call__(self, w, x, src, dst, degree=None):
        n = len(x.x)
        src, dst = _loops(src, dst, n)
        d = 1 / np.sqrt(np.bincount(dst, minlength=n) if degree is None else degree)
        return relu(gather_sum((x @ w["a"])[src] * (d[src] * d[dst])[:, None], dst, n) + x @ w["v"] + w["bias"])


class Le(Layer):
    """Differences to the in-neighbours, added up, and a node's own part: extrema stand out."""

    def weights(self):
        return {"a": (self.width, self.out), "a0": (self.out,), "b": (self.width, self.out), "c": (self.width, self.out), "c0": (self.out,)}

    def __call__(self, w, x, src, dst, degree=None):
        n = len(x.x)
        src, dst = _loops(src, dst, n)
        return gather_sum((x @ w["a"] + w["a0"])[src] - (x @ w["b"])[dst], dst, n) + x @ w["c"] + w["c0"]


#: Layer, heads of the first of two layers, what lies between them.
KINDS = {"sage": (Sage, 1, relu), "gat": (Gat, 8, elu), "gatv2": (Gatv2, 1, relu), "transformer": (Transformer, 8, relu), "arma": (Arma, 1, relu), "asap": (Le, 1, relu), "clusterscl": (Gat, 8, elu)}
#: The contrastive model: width of its projection, temperatures, weight of the entropy, rows of a batch.
PROJECTION, TAU, KAPPA, ETA, BATCH = 128, 0.07, 0.1, 0.1, 128
#: Clusters whose tables are computed at a time.
TOGETHER = 4


class Network:
    """Two layers and a linear head, fitted by Adam on cross-entropy over the whole community; deterministic under the seed.

    Without edges or training rows every model still gives an embedding. An unknown kind is an error."""

    def __init__(self, kind: str, width: int, hidden: int, classes: int, seed: int = 42, dropout: float = 0.0):
        if kind not in KINDS:
            raise ValueError(f"unknown model {kind}: one of {', '.join(KINDS)}")
        layer, heads, self.between = KINDS[kind]
        self.kind, self.dropout, self.rng = kind, dropout, np.random.default_rng(seed)
        self.layers, self.last = [layer(width, hidden, heads), layer(hidden, hidden)], relu if kind == "sage" else None
        shapes = {f"{i}.{k}": s for i, l in enumerate(self.layers) for k, s in l.shapes.items()} | {"head": (hidden, classes), "head0": (classes,)}
        if kind == "clusterscl":
            shapes |= {"p": (hidden, hidden), "p0": (hidden,), "o": (hidden, PROJECTION), "o0": (PROJECTION,), "clusters": (PROJECTION, max(2, classes))}
        self.w = {k: self._begin(s) for k, s in shapes.items()}
        if kind == "clusterscl":
            self.w["clusters"] = np.abs(self.rng.uniform(0, 1, self.w["clusters"].shape))

    def _begin(self, shape: tuple[int, ...]) -> np.ndarray:
        return np.zeros(shape) if len(shape) == 1 else self.rng.uniform(-1, 1, shape) * np.sqrt(6 / (shape[-1] + shape[-2]))

    def _dropped(self, v: Value, training: bool) -> Value:
        if not training or not self.dropout:
            return v
        return v * ((self.rng.random(v.x.shape) >= self.dropout) / (1 - self.dropout))

    def values(self, *prefixes: str, fixed: bool = False) -> dict[str, Value]:
        return {k: Value(v, fixed=fixed) for k, v in self.w.items() if not prefixes or k.startswith(prefixes)}

    def _layer(self, i: int, w: dict[str, Value], x: Value, src, dst, degree=None) -> Value:
        out = self.layers[i]({k.split(".", 1)[1]: v for k, v in w.items() if k.startswith(f"{i}.")}, x, src, dst, degree)
        return self.between(out) if not i else self.last(out) if self.last else out

    def embed(self, w: dict[str, Value], x, src, dst, training: bool = False) -> Value:
        first = self._layer(0, w, Value(x, fixed=True), src, dst)
        return self._layer(1, w, self._dropped(first, training), src, dst)

    def forward(self, x, src, dst=None) -> tuple[np.ndarray, np.ndarray]:
        """(embedding, scores of the classes). x: an array, or rows that are read when asked for; src: message sources, or Blocks without dst."""
        w = self.values(fixed=True)
        z = self.embed(w, x, src, dst).x if dst is not None else self._every(1, self._every(0, x, src), src)
        out = room((len(z), self.w["head0"].shape[0])) if "head" in self.w else None
        for part in chunks(len(z)) if out is not None else ():
            out[part] = z[part] @ self.w["head"] + self.w["head0"]
        return z, out

    def _every(self, i: int, x, blocks: Blocks) -> np.ndarray:
        """A layer's results for all nodes, block by block."""
        out, w = room((blocks.n, self.layers[i].out)), self.values(f"{i}.", fixed=True)

        def work(block) -> None:
            a, b, nodes, src, dst, degree = block
            out[a:b] = self._layer(i, w, Value(x[nodes], fixed=True), src, dst, degree).x[: b - a]

        for _ in side_by_side(work, blocks):
            pass
        return out

    def _back(self, i: int, x, blocks: Blocks, g: np.ndarray, grad: dict[str, np.ndarray], to: np.ndarray | None = None) -> None:
        """A layer's gradient where that of its results is g: added to `grad` by weight, and to `to`, if given, by node. Each block is computed again, so that no more than THREADS are on the tape."""

        def work(block):
            a, b, nodes, src, dst, degree = block
            if not g[a:b].any():
                return None
            w, v = self.values(f"{i}."), Value(x[nodes], fixed=to is None)
            out = self._layer(i, w, v, src, dst, degree)
            seed = np.zeros_like(out.x)
            seed[: b - a] = g[a:b]
            out.backward(seed)
            return w, nodes, v.grad

        for done in side_by_side(work, blocks):
            if done is not None:  # in order of the blocks, whichever is ready first
                self._add(grad, done[0])
                if to is not None and done[2] is not None:
                    to[done[1]] += done[2]

    def _add(self, grad: dict[str, np.ndarray], w: dict[str, Value]) -> None:
        for k, v in w.items():
            if v.grad is not None:
                grad[k] = grad[k] + v.grad

    def _gradient(self, x, src, dst, objective, decay: float, views: int = 1) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradient. objective(zs, add): the loss on the embeddings of `views` draws of dropout, which calls add(value, w, zs)
        for each term's tape, or its number once the tape has gone back, where zs are (view, rows, Value of these rows), so that no two terms are on it together."""
        grad = {k: decay * v for k, v in self.w.items()}
        if whole := dst is not None:
            w = self.values()
            tapes = [self.embed(w, x, src, dst, True) for _ in range(views)]
            zs = [t.x for t in tapes]
        else:
            first, zs, masks = self._every(0, x, src), [], []
            for _ in range(views):
                masks.append(self._mask(first.shape))
                zs.append(self._every(1, _Masked(first, masks[-1], self.dropout), src))
        gs = [room(z.shape) for z in zs]

        def add(value: Value | float, w: dict[str, Value], parts: list[tuple[int, np.ndarray, Value]]) -> float:
            if isinstance(value, Value):
                value.backward()
                value = float(value.x)
            self._add(grad, w)
            for i, rows, v in parts:
                gs[i][rows] += v.grad
            return value

        total = objective(zs, add)
        for i in range(views):
            if whole:
                tapes[i].backward(gs[i])
            else:
                to = room(first.shape)
                self._back(1, _Masked(first, masks[i], self.dropout), src, gs[i], grad, to)
                if masks[i] is not None:
                    for part in chunks(len(to)):
                        to[part] *= masks[i][part] / (1 - self.dropout)
                self._back(0, x, src, to, grad)
        if whole:
            self._add(grad, w)
        return total + decay / 2 * sum((v**2).sum() for v in self.w.values()), grad

    def _mask(self, shape: tuple[int, ...]) -> np.ndarray | None:
        if not self.dropout:
            return None
        out = room(shape, bool)
        for part in chunks(shape[0]):
            out[part] = self.rng.random(out[part].shape) >= self.dropout
        return out

    def loss(self, x, src, dst, y, rows, decay: float = 5e-4, anchor: tuple[np.ndarray, np.ndarray] | None = None):
        """Cross-entropy on `rows` and its gradient. anchor: (rows, embedding) that the embedding is drawn to, by 0.01 of
        the mean square. The contrastive model adds its bound over two views of the training rows."""
        contrastive = self.kind == "clusterscl" and len(rows) > 1

        def objective(zs, add) -> float:
            total = 0.0
            for part in chunks(len(rows)):
                at, w = rows[part], self.values("head")
                z, picked = Value(zs[0][at]), np.zeros((len(at), self.w["head0"].shape[0]))
                picked[np.arange(len(at)), y[at]] = 1 / len(rows)
                total += add(-(log_shares(z @ w["head"] + w["head0"]) * picked).sum(), w, [(0, at, z)])
            for part in chunks(len(anchor[0]) if anchor is not None else 0):
                z = Value(zs[0][anchor[0][part]])
                off = z - Value(anchor[1][part], fixed=True)
                total += add((off * off).sum() * (0.01 / anchor[1].size), {}, [(0, anchor[0][part], z)])
            order = self.rng.permutation(rows) if contrastive else rows[:0]

            def batch(part: slice):
                at, w = np.sort(order[part]), self.values("p", "o", "clusters")
                seen = [(i, at, Value(z[at])) for i, z in enumerate(zs)]
                both = [unit_rows(relu(z @ w["p"] + w["p0"]) @ w["o"] + w["o0"]) for _, _, z in seen]
                same = 2 if len(zs) == 1 else 1  # two views without dropout are the same
                value = contrast(stack(both), w["clusters"], np.tile(y[at], len(zs)), same) * (len(at) / len(rows))
                value.backward()
                return float(value.x), w, seen

            batches = chunks(len(order), BATCH)
            for told in side_by_side(batch, batches) if len(order) > BATCH else map(batch, batches):  # in order of the batches, whichever is ready first
                total += add(*told)
            return total

        return self._gradient(x, src, dst, objective, decay, 2 if contrastive and self.dropout else 1)

    def fit(self, x, src, dst, y, rows, epochs: int, lr: float, anchor=None) -> None:
        adam = Adam(self.w, lr)
        for _ in range(epochs):
            adam.step(self.loss(x, src, dst, y, rows, anchor=anchor)[1])


class _Masked:
    """Rows of an array after dropout, read when asked for."""

    def __init__(self, x: np.ndarray, mask: np.ndarray | None, share: float):
        self.x, self.mask, self.share = x, mask, share

    def __getitem__(self, rows):
        return self.x[rows] if self.mask is None else self.x[rows] * (self.mask[rows] / (1 - self.share))


class Adam:
    """Steps of Adam on weights by name, in place of what the dictionary holds."""

    def __init__(self, w: dict[str, np.ndarray], lr: float):
        self.w, self.lr, self.t = w, lr, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k], self.v[k] = 0.9 * self.m[k] + 0.1 * g, 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] = self.w[k] - self.lr * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class LinkNetwork(Network):
    """A network's two layers, and two linear layers that score an edge by the product of its ends' embeddings; fitted by Adam on
    cross-entropy of edges against as many pairs that are none, drawn anew each epoch. Messages pass over training edges only."""

    def __init__(self, kind: str, width: int, hidden: int, seed: int = 42, dropout: float = 0.0):
        super().__init__("gat" if kind == "clusterscl" else kind, width, hidden, 1, seed, dropout)
        self.w = {k: v for k, v in self.w.items() if not k.startswith("head")}
        self.w |= {k: self._begin(s) for k, s in {"f": (hidden, hidden), "f0": (hidden,), "g": (hidden, 1), "g0": (1,)}.items()}
        self.last = None

    def _scores(self, w: dict[str, Value], z: Value, pairs: np.ndarray) -> Value:
        return (relu((z[pairs[:, 0]] * z[pairs[:, 1]]) @ w["f"] + w["f0"]) @ w["g"] + w["g0"]).reshape(-1)

    def link_loss(self, x, src, dst, edges: np.ndarray, others: np.ndarray, decay: float = 5e-4):
        n = max(len(edges) + len(others), 1)

        def objective(zs, add) -> float:
            total = 0.0
            for pairs, sign in ((edges, -1.0), (others, 1.0)):
                for part in chunks(len(pairs)):
                    at, places = np.unique(pairs[part], return_inverse=True)
                    z, w = Value(zs[0][at]), self.values("f", "g")
                    total += add(softplus(self._scores(w, z, places.reshape(-1, 2)) * sign).sum() * (1 / n), w, [(0, at, z)])
            return total

        return self._gradient(x, src, dst, objective, decay)

    def fit_links(self, x, src, dst, edges: np.ndarray, taken: np.ndarray, epochs: int, lr: float) -> None:
        adam = Adam(self.w, lr)
        for _ in range(epochs):
            adam.step(self.link_loss(x, src, dst, edges, no_edges(self.rng, len(edges), len(x), taken))[1])

    def score(self, x, src, dst, pairs: np.ndarray) -> np.ndarray:
        z, w, out = self.forward(x, src, dst)[0], self.values("f", "g", fixed=True), np.zeros(len(pairs))
        for part in chunks(len(pairs)):
            at, places = np.unique(pairs[part], return_inverse=True)
            out[part] = self._scores(w, Value(z[at]), places.reshape(-1, 2)).x
        return out


def no_edges(rng: np.random.Generator, n: int, nodes: int, taken: np.ndarray, tries: int = 20) -> np.ndarray:
    """n pairs of different nodes that are no edge, fewer if `tries` rounds of draws don't find as many. taken: a * nodes + b of each edge, both ways, sorted."""
    out = np.zeros((0, 2), np.int64)
    for _ in range(tries):
        drawn = rng.integers(0, nodes, (n - len(out), 2))
        at = drawn[:, 0] * nodes + drawn[:, 1]
        known = taken[np.minimum(np.searchsorted(taken, at), len(taken) - 1)] == at if len(taken) else np.zeros(len(at), bool)
        out = np.concatenate([out, drawn[~known & (drawn[:, 0] != drawn[:, 1])]])
        if len(out) == n:
            break
    return out


def stack(parts: Sequence[Value]) -> Value:
    cuts = np.cumsum([0, *(len(p.x) for p in parts)])
    return Value(np.concatenate([p.x for p in parts]), [(p, lambda g, a=a, b=b: g[a:b]) for p, a, b in zip(parts, cuts, cuts[1:], strict=False)])


def contrast(views: Value, clusters: Value, y: np.ndarray, copies: int = 1) -> Value:
    """The cluster-aware supervised contrastive loss of a batch of unit rows. Each row belongs to clusters by share;
    within a cluster, another row is scored by its likeness to the anchor, or the anchor's to the cluster, whichever is
    greater by a sigmoid. Of rows with the anchor's label, the likelihood summed over clusters is taken: the variational
    bound where its posterior is exact. ETA times the shares' negative entropy is added. With `copies`, each row stands for as many equal ones."""
    # The likelihood is needed of pairs with one label only; the gradient is written out, some clusters at a time, so that their tables (cluster, other row, anchor) stay in the cache.
    v, c, n, k = views.x, clusters.x, len(y), clusters.x.shape[1]
    same = (y[:, None] == y[None, :]) * (copies - np.eye(n))
    pairs = np.flatnonzero(same)
    i = pairs % n
    per = (same / np.maximum(same.sum(0), 1) / n).reshape(-1)[pairs]
    at, row = v @ c, v @ v.T
    log_pi = log_shares(Value(at / KAPPA, fixed=True)).x
    pi = np.exp(log_pi)
    up, down, at_t, row_t = np.exp(row), np.exp(-np.clip(at.T, -600, 600)), at.T / TAU, row / TAU
    rest, total, left = np.empty((k, n, n)), np.empty((k, n)), np.empty((k, n))
    likely, slope = np.empty((k, len(pairs))), np.empty((k, len(pairs)))
    tables = [np.empty((min(k, TOGETHER), n, n)) for _ in range(3)]
    for of in chunks(k, TOGETHER):
        h = rest[of]
        gate, part, share = (t[: len(h)] for t in tables)
        np.multiply(up, down[of, None], gate)
        gate += 1
        np.reciprocal(gate, gate)
        np.subtract(at_t[of, None], row_t, part)
        part *= gate
        np.add(part, row_t, share)
        share -= share.max(1, keepdims=True)
        np.exp(share, share)
        np.subtract(1 / TAU, part, h)  # how the score follows the likeness of the two rows: (1 - gate) * (1 - gate * difference)
        np.subtract(1, gate, gate)
        h *= gate
        likely[of], slope[of] = (np.take(t.reshape(len(h), -1), pairs, axis=1) for t in (share, h))
        share.reshape(len(h), -1)[:, :: n + 1] *= 1 - 1 / copies  # a row is not among its others, its copies are
        h *= share
        total[of], left[of] = share.sum(1) * copies + 1e-18, h.sum(1) * copies
    likely *= (pi.T / total)[:, i]
    whole = likely.sum(0) + 1e-18
    loss = (pi * log_pi).sum() * (ETA / n) - (np.log(whole) * per).sum()
    likely *= per / whole
    slope *= likely
    by_anchor = lambda x: np.stack([np.bincount(i, w, n) for w in x])
    drawn, slope_sums = by_anchor(likely), by_anchor(slope)
    to_cluster = drawn * ((total - 1e-18) / TAU - left) / total - (drawn / TAU - slope_sums)
    to_row = np.einsum("ki,kji->ji", drawn / total * copies, rest)
    to_row.reshape(-1)[pairs] -= slope.sum(0)
    to_pi = pi * (1 + log_pi) * (ETA / n) - drawn.T
    to_at = (to_pi - pi * to_pi.sum(1, keepdims=True)) / KAPPA + to_cluster.T
    to_views, to_clusters = to_at @ c.T + (to_row + to_row.T) @ v, v.T @ to_at
    return Value(loss, [(views, lambda g: g * to_views), (clusters, lambda g: g * to_clusters)])
