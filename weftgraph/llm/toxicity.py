"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import saved, tidy

_GAP = r"[^\p{L}\p{N}_]+"


#: Inflected words share stems: a word's first characters, as many as these, are terms as well, marked by a dash.
STEMS = (4, 5)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of all words of the texts, lower-cased, in turn: the text, and the number of the word; and the different words, then their
    stems of each size, null where there is none."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), _GAP)
    words = lists.flatten().dictionary_encode()
    different = words.dictionary
    stems = [pc.if_else(pc.greater(pc.utf8_length(different), n), pc.binary_join_element_wise(pc.utf8_slice_codeunits(different, 0, n), "-", ""), pa.scalar(None, different.type)) for n in STEMS]
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    return of, words.indices.to_numpy(), pa.concat_arrays([pc.if_else(pc.equal(different, ""), pa.scalar(None, different.type), different), *stems])


def read_terms(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vocabulary's terms in each text: their numbers, rising, how often each occurs, and where each text's begin and the last one's end."""
    of, word, terms = _words(texts)
    known = pc.fill_null(pc.index_in(terms, value_set=vocabulary), -1).to_numpy().astype(np.int64).reshape(1 + len(STEMS), -1)
    found = known[:, word]
    at, counts = np.unique((of * np.int64(len(vocabulary)) + found)[found >= 0], return_counts=True)
    return at % max(len(vocabulary), 1), counts, np.searchsorted(at, np.arange(len(texts) + 1) * np.int64(len(vocabulary)))


def slices(texts: pa.Array, rows: int = 256, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts, of up to so many and about so many bytes, or of one text."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)), 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size))))
        yield at, to
        at = to


def term_counts(text: str | None) -> dict[str, int]:
    """Lower-cased words and their stems, each with its number."""
    _, word, terms = _words(pa.array([text], pa.string()))
    out, names, n = {}, terms.to_pylist(), len(terms) // (1 + len(STEMS))
    for w, c in zip(*(x.tolist() for x in np.unique(word, return_counts=True)), strict=True):
        for t in names[w::n]:
            if t is not None:
                out[t] = out.get(t, 0) + c
    return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers from each start to its end, one range after the other."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


class BlockMaxIndex:
    """Exact k nearest of unit vectors by cosine, for a batch of texts at a time. Postings lie by term and block of examples, with the
    largest weight of each term in each block; those of terms that over 1 / 16 of the examples have lie as a table. A block's bound
    for a text is the sum of these weights. A text's block of the highest bound is read first, then all others whose bound isn't under its k-th similarity."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 256):
        self.size, self.block, self.n_blocks, self.visited = len(vectors), block, max(1, -(-len(vectors) // block)), 0
        terms = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        weights = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        example = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        order = np.lexsort((example, terms))
        terms, example, weights = terms[order], example[order], weights[order]
        lists = terms * self.n_blocks + example // block
        self.largest = np.zeros((n_terms, self.n_blocks))
        if len(first := np.flatnonzero(np.diff(lists, prepend=-1))):
            self.largest.reshape(-1)[lists[first]] = np.maximum.reduceat(weights, first)
        common = np.bincount(terms, minlength=n_terms) * 16 > self.size
        self.row = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
        self.table = np.zeros((int(common.sum()), self.size))
        many = common[terms]
        self.table[self.row[terms[many]], example[many]] = weights[many]
        self.example, self.weight = example[~many].astype(np.int32), weights[~many]
        self.starts = np.searchsorted(lists[~many], np.arange(n_terms * self.n_blocks + 1)).astype(np.int32)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, similarities and numbers of the k most similar examples with a similarity over 0; ties by the smaller
        number. Text i has the terms from starts[i] to starts[i + 1]."""
        n = len(starts) - 1
        text = np.repeat(np.arange(n), np.diff(starts))
        bounds = np.zeros((n, self.n_blocks))
        if len(some := np.flatnonzero(np.diff(starts))):
            bounds[some] = np.add.reduceat(weights[:, None] * self.largest[terms], starts[some], axis=0)
        row = self.row[terms]
        query = np.zeros((n, len(self.table)))
        query[text[row >= 0], row[row >= 0]] = weights[row >= 0]
        text, terms, weights = text[row < 0], terms[row < 0], weights[row < 0]
        scores = np.zeros((n, self.size))

        def read(b: int, mine: np.ndarray) -> None:
            at, first, last = np.flatnonzero(mine), b * self.block, min((b + 1) * self.block, self.size)
            if not len(at) or first >= last:
                return
            self.visited += len(at)
            place = np.cumsum(mine) - 1
            here = np.flatnonzero(mine[text])
            begin, end = self.starts[terms[here] * self.n_blocks + b], self.starts[terms[here] * self.n_blocks + b + 1]
            postings = _ranges(begin.astype(np.int64), end.astype(np.int64))
            flat = np.repeat(place[text[here]] * (last - first), end - begin) + (self.example[postings] - first)
            rare = np.bincount(flat, np.repeat(weights[here], end - begin) * self.weight[postings], len(at) * (last - first))
            scores[at, first:last] = query[at] @ self.table[:, first:last] + rare.reshape(len(at), -1)

        best = bounds.argmax(1)
        for b in range(self.n_blocks):
            read(b, (best == b) & (bounds[:, b] > 0))
        floor = np.partition(scores, -k, axis=1)[:, -k] if self.size >= k else np.zeros(n)
        for b in range(self.n_blocks):
            read(b, (best != b) & (bounds[:, b] > 0) & (bounds[:, b] >= floor - 1e-9))
        floor = np.partition(scores, -k, axis=1)[:, -k] - 1e-9 if self.size >= k else np.zeros(n)
        out = []
        for i in range(n):
            ids = np.flatnonzero((scores[i] > 0) & (scores[i] >= floor[i]))
            similar = np.round(scores[i, ids], 9)
            keep = np.lexsort((ids, -similar))[:k]
            keep = keep[similar[keep] > 0]
            out.append((similar[keep], ids[keep]))
        return out


@dataclass
class Model:
    """Fitted by fit(); its size is bounded by the terms of fit()'s max_examples texts."""

    vocabulary: pa.Array
    weight: np.ndarray  # of each term: its idf and relevance
    ids: np.ndarray
    labels: np.ndarray
    index: BlockMaxIndex
    weights: np.ndarray  # of each label: how many labelled documents an example stands for
    rate: float
    k: int
    knots: tuple[list[float], list[float]] = ((0.0, 1.0), (0.0, 1.0))

    def votes(self, terms: np.ndarray, counts: np.ndarray, starts: np.ndarray, without: np.ndarray | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each text its vote, and its neighbours' similarities and numbers; without: an example for each text that is none of them. Neighbours vote with
        weights 1 / (distance + 0.1), and the rate of label 1 with the weight of one at distance 0.9. A text without known terms has no neighbours."""
        weights = self.weight[terms] * (1 + np.log(counts))
        length = np.sqrt(np.bincount(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), weights * weights, len(starts) - 1))
        weights = weights / np.repeat(np.maximum(length, 1e-300), np.diff(starts))
        for i, (similar, near) in enumerate(self.index.nearest(terms, weights, starts, self.k + (without is not None))):
            if without is not None:
                similar, near = similar[near != without[i]][: self.k], near[near != without[i]][: self.k]
            w = self.weights[self.labels[near]] / (1.1 - np.minimum(similar, 1.0))
            yield float((self.rate + (w * self.labels[near]).sum()) / (1 + w.sum())), similar, near

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.knots))


def unit(weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A text's TF-IDF vector of length 1: the terms' weights times 1 + ln of their counts."""
    v = weights * (1 + np.log(counts))
    return v / max(np.sqrt((v * v).sum()), 1e-300)


def _isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of a rising calibration: pooled adjacent violators, each pool's rate drawn to 1/2 by one row's weight."""
    pools: list[list[float]] = []
    for i in np.argsort(votes, kind="stable"):
        pools.append([votes[i] * weights[i], labels[i] * weights[i], weights[i]])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] / pools[-2][2] >= pools[-1][0] / pools[-1][2]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x, y = [0.0], [0.0]
    for v, one, w in pools:
        if 0 < v / w < 1:
            x.append(v / w)
            y.append(max(y[-1], (one + 0.5) / (w + 1)))
    return [*x, 1.0], [*y, 1.0]


def _count_terms(texts: DataFrame) -> pa.Table:
    """(id, y, terms, counts) of each example, by id. texts: (id, y, text), fit()'s examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                counts = dict(sorted(term_counts(b.column(2)[i].as_py()).items()))
                lists = [pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *lists], names=["id", "y", "terms", "counts"])

    return texts.mapInArrow(tidy(run), "id long, y int, terms array<string>, counts array<long>").toArrow().sort_by("id").combine_chunks()


def _apart(rows: list, distance: int = 11) -> list:
    """Of near copies of one label, by fingerprints of 64 bits, the one with the smallest id. rows: at most fit()'s examples."""
    rows = sorted(rows, key=lambda r: r.id)
    prints, labels = np.array([r.fingerprint for r in rows], np.int64).view(np.uint64), np.array([r.y for r in rows])
    keep = np.ones(len(rows), bool)
    for i in range(len(rows)):
        if keep[i]:
            keep[i + 1 :] &= (np.bitwise_count(prints[i + 1 :] ^ prints[i]) > distance) | (labels[i + 1 :] != labels[i])
    return [r for r, k in zip(rows, keep, strict=True) if k]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 1024, k: int = 15, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most max_examples labelled documents of each class, taken in order of a hash of their key.

    A key with several labels counts as 1 if one of them is; null keys and labels are left out, as are labels without a document. Of
    examples that are copies of each other, exact or near, one counts, lest a copied text's rare words stand out. The vocabulary is
    all terms of the examples, words and stems. A term's weight is its idf, ln((1 + documents) / (1 + those with it)) + 1, counted over all documents, times its
    relevance, log2(2 + (examples of label 1 with it - 1) / (examples of label 0 with it, of as many as of label 1, 1 at least)): 1 for a term that tells nothing.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("y"))
    marked = saved(marked, "labels")
    totals = dict(marked.groupBy("y").count().collect())
    sample = [marked.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_examples) for y in (0, 1)]
    sample = saved(sample[0].unionByName(sample[1]), "sample")
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.max("text").alias("text"))
    texts = saved(texts, "examples")
    kept = {r.id for r in _apart(texts.select("id", "y").join(simhash.fingerprints(texts, key="id"), "id").collect())}
    counted = _count_terms(texts)
    counted = counted.filter(pa.array([i in kept for i in counted.column("id").to_pylist()], pa.bool_())).combine_chunks()
    y = counted.column("y").to_numpy().astype(np.int64)
    sizes = np.array([len(x) for x in counted.column("terms")], np.int64)
    words = counted.column("terms").combine_chunks().flatten().dictionary_encode() if len(y) else pa.array([], pa.string()).dictionary_encode()
    numbers, counts = words.indices.to_numpy().astype(np.int64), counted.column("counts").combine_chunks().flatten().to_numpy() if len(y) else np.zeros(0, np.int64)
    vocabulary = words.dictionary
    sent = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(sent.value), np.int64), 0
        for b in batches:
            rows += b.num_rows
            for at, to in slices(b.column(0)):
                df += np.bincount(read_terms(b.column(0).slice(at, to - at), sent.value)[0], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, some), pa.int32()), pa.array(np.append(rows, df[some]), pa.int64())], names=["term", "n"])

    found = docs.select(text).mapInArrow(tidy(frequencies), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df, rows = np.zeros(len(vocabulary) + 1, np.int64), found.column("term").to_numpy()
    df[rows] = found.column("n").to_numpy()  # the last, -1, is the number of documents
    sent.unpersist()

    n = np.bincount(y, minlength=2)
    label_of = np.repeat(y, sizes)
    ones, zeros = np.bincount(numbers[label_of == 1], minlength=len(vocabulary)), np.bincount(numbers[label_of == 0], minlength=len(vocabulary))
    weight = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * np.log2(2 + np.maximum(ones - 1, 0) / np.maximum(zeros * n[1] / max(n[0], 1), 1))
    parts = [np.argsort(x) + o for x, o in zip(np.split(numbers, np.cumsum(sizes)[:-1]), np.cumsum(sizes) - sizes, strict=True)] if len(y) else []
    # Examples of one label with the same weightiest term lie side by side, so that blocks hold like examples.
    heaviest = [int(numbers[p[np.argmax(weight[numbers[p]])]]) if len(p) else -1 for p in parts]
    ids = counted.column("id").to_numpy() if len(y) else np.zeros(0, np.int64)
    order = np.lexsort((ids, heaviest, y)) if len(y) else []
    rows = [(numbers[parts[i]], counts[parts[i]]) for i in order]
    weights = np.array([totals.get(v, 0) / n[v] if n[v] else 0.0 for v in (0, 1)])
    index = BlockMaxIndex([(t, unit(weight[t], c)) for t, c in rows], len(vocabulary))
    rate = float((weights[1] * n[1] + 0.5) / (weights @ n + 1))
    model = Model(vocabulary, weight, ids[order], y[order], index, weights, rate, k)
    if len(y):
        told: list[float] = []
        for at in range(0, len(rows), 128):  # bounded on the driver
            part = rows[at : at + 128]
            starts = np.cumsum([0, *(len(t) for t, _ in part)])
            told += [v for v, _, _ in model.votes(np.concatenate([t for t, _ in part]), np.concatenate([c for _, c in part]), starts, np.arange(at, at + len(part)))]
        model.knots = _isotonic(np.array(told), model.labels, weights[model.labels])
    pa.default_memory_pool().release_unused()
    return model


class Scorer:
    """A model's scores of texts; copies are scored once, as far as a bounded memo goes."""

    def __init__(self, model: Model, memo: int = 2_000):
        self.model, self.memo, self.known = model, memo, {}

    def __call__(self, texts: pa.Array) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        m = self.model
        for first, last in slices(texts):
            part = texts.slice(first, last - first)
            digests = [xxhash.xxh128_digest((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in part]
            if len(self.known) > self.memo:
                self.known.clear()
            new = list({d: i for i, d in enumerate(digests) if d not in self.known}.values())
            terms, counts, starts = read_terms(part.take(pa.array(new, pa.int64())), m.vocabulary)
            for i, (vote, similar, near) in zip(new, m.votes(terms, counts, starts), strict=True):
                self.known[digests[i]] = m.calibrated(vote), list(zip(m.ids[near].tolist(), m.labels[near].tolist(), similar.tolist(), strict=True))
            yield from (self.known[d] for d in digests)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted, evidence): the calibrated vote of each whole text's nearest examples, 1 if it is 1/2 or
    more, and those examples (doc_id, label, similarity). The score depends on the text alone: a null, empty or unknown
    text has no neighbours and the rate of label 1 among examples like it. Repeated rows keep a row each."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            found = list(scorer(b.column(1)))
            near = [[{"doc_id": i, "label": y, "similarity": c} for i, y, c in e] for _, e in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array(near, evidence)], names=["id", "score", "predicted", "evidence"])

    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(run), "id long, score double, predicted int, evidence array<struct<doc_id: long, label: int, similarity: double>>").withColumnRenamed("id", key)


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents whose score is under 1/2, with all their columns."""
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            kept = b.filter(pa.array([x < 0.5 for x, _ in scorer(b.column(at))], pa.bool_()))
            yield from (kept.slice(i, 1000) for i in range(0, kept.num_rows, 1000))

    return docs.mapInArrow(tidy(run), docs.schema)


def learnable(labels: DataFrame, key: str = "doc_id", folds: int = 5) -> DataFrame:
    """The labels outside the held-out fold: CRC-32 of the key as text, modulo `folds`, is not 0."""
    return labels.where(F.crc32(F.col(key).cast("string").cast("binary")) % folds != 0)
