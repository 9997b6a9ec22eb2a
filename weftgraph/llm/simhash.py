"""SimHash near-duplicates by meet-in-the-middle ball hashing, and connected components of their links."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, even_join, saved, tidy, trim

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(WORD.encode())


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 bits as a signed long: a bit is 1 if set in over half of the XXH64 hashes of the text's shingles
    of `words` lower-cased words, repeats included. A shorter text is one shingle; one without words has 0."""
    found = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_UPPER))
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    joined, at, starts = b" ".join(found), 0, [0]
    for w in found:
        at += len(w) + 1
        starts.append(at)
    size = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[starts[i] : starts[i + size] - 1], seed) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):  # bounded for very long texts
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint long) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [fingerprint(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["id", "fingerprint"])

    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return slim.mapInArrow(tidy(run), "id long, fingerprint long").withColumnRenamed("id", key)


def ball_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): links of distinct fingerprints (column `fingerprint`) that join all within `distance` bits.

    Each fingerprint emits all variants within half the distance, so two within the distance meet on a
    variant between them. At most a ball of fingerprints meets on one variant, 65 at distance 2.
    Those that meet are within the distance of each other, so that it is enough to link each to the
    next on the variant; the distance of each link is verified all the same.
    """
    if distance not in (0, 2):
        raise ValueError("a ball of half the distance is 1 or 65 variants: distance is 0 or 2")
    flips = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)] * (distance // 2)
    distinct = prints.select("fingerprint").distinct()
    masks = F.array(*[F.lit(x).cast("long") for x in flips])
    emitted = distinct.select("fingerprint", F.explode(F.transform(masks, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("variant"))
    meeting = Window.partitionBy("variant").orderBy("fingerprint")
    pairs = emitted.select(F.lag("fingerprint").over(meeting).alias("a"), F.col("fingerprint").alias("b")).where("a is not null")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()


#: Links of up to this many are joined by one task, in arrays; more by plans, until so few are left.
FEW_LINKS = 1 << 20


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), rising, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))  # each root takes the smallest one next to it
        while (root[root] != root).any():
            root = root[root]
        crossing = root[a] != root[b]
        a, b = a[crossing], b[crossing]
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """least_reached() of all links of a task."""
    links = pa.Table.from_batches(batches, pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    found = least_reached(links.column("u").to_numpy(), links.column("v").to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, few: int | None = None) -> DataFrame:
    """(node, root): the smallest node that each node with a link can reach.

    Alternates large-star and small-star steps, each an aggregate for the least neighbour and a join,
    until a round changes no link, or `few` links are left (FEW_LINKS): one task joins these, which spares the tasks of all rounds.
    Each round's links are a table in the shared folder, in place of those before.
    """
    few = FEW_LINKS if few is None else few
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges, was = saved(edges, "links"), None
    for _ in range(max_rounds + 1):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] <= few:
            return edges.coalesce(1).mapInArrow(tidy(_joined), "node long, root long")
        if now == was:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = even_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        before, edges, was = edges, saved(small, "links"), now
        discard(before)
    raise RuntimeError(f"links did not settle in {max_rounds} rounds")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint long, component_id): documents whose fingerprints differ in at most `distance`
    bits are linked; component_id is the smallest key that a document can reach, itself included.

    Null and empty texts have fingerprint 0 and are linked like others. Rows of one key keep a row each.
    A null key is never a component's id unless all its keys are null. An empty table gives no rows.
    Copies share a fingerprint, so links are sought among distinct fingerprints only, and a group of
    copies, however large, is a single one.
    """
    prints = saved(fingerprints(docs, words, key, text), "prints")
    found = components(ball_links(prints, distance))
    owners = prints.groupBy("fingerprint").agg(F.min(key).alias("_least"))
    owners = owners.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    roots = owners.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = saved(owners.join(roots, "root").select("fingerprint", "component_id"), "classes")
    return even_join(prints, classes, "fingerprint").select(key, "fingerprint", "component_id")


# --- similarities that a few bits can't span ------------------------------------------------------------------------

#: Sets of up to this many shingles are their own sketch; larger ones have 8 words of 64 bits.
SMALL, SKETCH_WORDS = 64, 8


def _mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number stirred, so that all its bits depend on all."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _shingles(text: str | None, words: int) -> np.ndarray:
    """The set of hashes of a text's shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    found = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_UPPER))
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    n = len(found) - size + 1 if found else 0
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of hashes in 8 words of 64 bits: a bit is 1 if set in over half of as many hashes drawn from each."""
    ones = np.zeros(64 * SKETCH_WORDS, np.int64)
    step = np.arange(SKETCH_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 16 * 255):  # bounded for very long texts
        drawn = _mixed(hashes[at : at + 16 * 255, None] + step)
        lanes = np.unpackbits(drawn.view(np.uint8).reshape(len(drawn), -1), axis=1, bitorder="little").view(np.uint64)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # 255 bits at most fit a lane of 8
        ones += sums.view(np.uint8).reshape(len(sums), -1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)


def common_shingles(texts: DataFrame, words: int, sample: int = 4096, most: int = 200_000) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes, sorted, and counts of the shingles that at least two of some `sample` different texts have, at most `most`; and of
    how many texts each of these stands for one. texts: (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(t.as_py(), words).view(np.int64))], names=["shingle"])

    step = max(1, -(-texts.count() // sample))
    some = texts.select("text").where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).distinct()
    counts = some.mapInArrow(tidy(run), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(most).toArrow()
    hashes, n = (counts.column(c).to_numpy().astype(np.int64) for c in ("shingle", "n"))
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], n[order], step


def _prefix(hashes: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The first of a set in order of (count among common shingles, hash), so many that two sets of `similarity` share one."""
    n = len(hashes) and len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    ranks = np.zeros(len(hashes), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        ranks = np.where(common[0][at] == hashes, common[1][at], 0)
    return hashes[np.argsort(ranks, kind="stable")[:n]]  # hashes are sorted


#: What a pair's sketches tell: similar; not told, to be counted; (null) not similar.
SURE, OPEN = 1, 0


def _spread(sizes: Column, others: Column, similarity: float) -> tuple[Column, Column]:
    """Of two large sets whose similarity is just `similarity`: the bits in which their sketches differ, and their deviation."""
    bits = 64 * SKETCH_WORDS
    cosine = F.least(F.lit(similarity / (1 + similarity)) * (sizes + others) / F.sqrt(sizes.cast("double") * others), F.lit(1.0))
    middle = F.acos(cosine) / F.lit(math.pi) * bits
    return middle, F.sqrt(middle * (1 - middle / bits)) + 1


def told(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b, d, told): of the pairs (a, b) of nodes, those that may be similar. Two small sets are counted. Of two large ones the
    sketches differ in d bits: 3.5 deviations under what the similarity makes it, the pair is SURE (a pair just under `similarity` is
    taken for one once in 4,000); over 5 beyond it, it goes (once in 3 million of those just at it); else, and for a small and a large set, it is OPEN."""
    side = lambda s: sketches.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    both = even_join(pairs, side("a"), "a").join(side("b"), "b")
    a, b = F.col("size_a"), F.col("size_b")
    both = both.where(F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9)
    shared = F.size(F.array_intersect("sketch_a", "sketch_b"))
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    middle, deviation = _spread(a, b, similarity)
    small, large = (a <= SMALL) & (b <= SMALL), (a > SMALL) & (b > SMALL)
    d = F.when(large, apart).otherwise(0)
    verdict = F.when(small, F.when(shared >= F.lit(similarity) * (a + b - shared) - 1e-9, SURE)).when(large, F.when(F.col("d") <= middle - 3.5 * deviation, SURE).when(F.col("d") <= middle + 5 * deviation, OPEN)).otherwise(OPEN)
    return both.withColumn("d", d).withColumn("told", verdict).where("told is not null").select("a", "b", "d", "told")


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, crowd: int = 16, block: int = 128, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id): documents whose sets of shingles of `words` words have a Jaccard similarity of `similarity` or more
    are linked; component_id is the smallest key that a document can reach.

    Documents with the same set are one node, known by 64 bits of the set's digest. Nodes have a fingerprint of 64 bits, sought by ball
    hashing as in near_duplicates(), and a sketch of 512 bits that tells most pairs. At a similarity of 0.8 fingerprints differ
    in 10 bits or so, and a ball of 5 has 8 million variants, so ball hashing only joins large groups of close copies; all other
    pairs come from an exact filter: sets as similar as that share one of their first 1 - `similarity` shingles in any order that holds
    for all, here rare ones first, as told by a sample. Nodes that share such a shingle meet there. Each is held
    against the first one there; then, where a shingle's nodes still are of several components, all its pairs of different components are,
    up to `crowd` nodes as pairs, more in blocks of `block` against each other. Pairs that sketches don't tell, and that still
    join components, are counted shingle by shingle, those of a block within it, on the most crowded shingle that both have: what comes
    back from a block are links, fewer than its nodes, or its nodes. Only pairs with a set of over WHOLE shingles come back as such. No pair is left out.
    Null, empty and repeated rows as in near_duplicates(), but a row without a key joins no others; a text shorter than a shingle is one.
    """
    slim = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    spark, common = docs.sparkSession, common_shingles(slim, words)
    trim()  # the driver's Python, too
    sent = spark.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task's copies post their shingles once, as far as a bounded memory goes
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, rows = b.slice(at, 64), []
                for t in part.column(1):
                    hashes = _shingles(t.as_py(), words)
                    node = xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)
                    wide = sketch(hashes)
                    first = None if node in seen else _prefix(hashes, similarity, sent.value).view(np.int64)
                    seen.add(node)
                    rows.append((node, len(hashes), int(wide[0]), wide if len(hashes) > SMALL else hashes.view(np.int64), first))
                if len(seen) > 1_000_000:
                    seen.clear()
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=["id", "node", "size", "print", "sketch", "first"])

    prints = saved(slim.mapInArrow(tidy(run), "id long, node long, size int, print long, sketch array<long>, first array<long>"), "prefixes")
    members = saved(prints.select("id", "node"), "members")
    nodes = saved(prints.groupBy("node").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("print").alias("print"), F.first("sketch").alias("sketch")).where("least is not null"), "nodes")

    # A shingle that the sample shows with over 4,096 nodes is dealt to parts of some 4,096; the sample's table is bounded.
    parts = [(int(h), int(-(-c * common[2] // 4096))) for h, c in zip(common[0].view(np.int64), common[1]) if c * common[2] > 4096]
    crowded = spark.createDataFrame(parts, "shingle long, parts int")
    posted = prints.where("first is not null").select(F.explode("first").alias("shingle"), "node").join(F.broadcast(crowded), "shingle", "left")
    posted = posted.select("shingle", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")) + 1, F.lit(0)).cast("int").alias("part"), "node")
    there = Window.partitionBy("shingle", "part")
    met = posted.withColumns({"first": F.min("node").over(there), "last": F.max("node").over(there)}).where("part > 0 or first != last").select("shingle", "part", "node", "first")
    met = saved(met.distinct(), "met")
    discard(prints)

    stars = met.select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    heads = met.where("part > 0").select("shingle", "first").distinct()
    heads = heads.join(heads.groupBy("shingle").agg(F.min("first").alias("a")), "shingle").select("a", F.col("first").alias("b"))
    owners = nodes.groupBy("print").agg(F.min("node").alias("a"))
    same = even_join(nodes.select("print", F.col("node").alias("b")), owners, "print").select("a", "b")
    balls = ball_links(nodes.select(F.col("print").alias("fingerprint"))).join(owners.toDF("a", "x"), "a").join(owners.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = saved(stars.unionByName(heads).unionByName(same).unionByName(balls).where("a != b").distinct(), "pairs")
    checked = saved(told(pairs, nodes, similarity), "told")
    sure = saved(components(checked.where(F.col("told") == SURE)), "sure")

    rest = _contested(met.select("shingle", "node").distinct(), sure)
    few = rest.where(F.col("m") <= crowd).select("shingle", "node", "root")
    few = few.join(few.toDF("shingle", "node2", "root2"), "shingle").where("node < node2 and root != root2").select(F.col("node").alias("a"), F.col("node2").alias("b"))
    few = told(saved(few.distinct().join(pairs, ["a", "b"], "left_anti"), "few"), nodes, similarity)
    checked = saved(checked.unionByName(few), "told")
    links = checked.where(F.col("told") == SURE).select("a", "b")
    for nearest in (True, False):  # first one pair for each node, the closest; what then still joins components is counted, all of it
        roots = saved(components(links), "roots")
        open_ = _crossing(checked.where(F.col("told") == OPEN), roots)
        open_ = open_.groupBy("a").agg(F.min(F.struct("d", "b"))["b"].alias("b")) if nearest else open_.join(counted, ["a", "b"], "left_anti")
        counted = open_ = saved(open_.select("a", "b").distinct(), "open")
        if not open_.limit(1).count():
            break
        links = links.unionByName(saved(exactly_similar(open_, slim, members, nodes, words, similarity), "links"))
    else:
        roots = saved(components(links), "roots")

    rest = _contested(rest.where(F.col("m") > crowd).select("shingle", "node"), roots)
    # The largest component's nodes on a shingle meet the others' blocks only.
    is_giant = F.col("root") == F.col("giant.root")
    others, blocks = F.ceil((F.col("m") - F.col("giant.n")) / block), F.ceil(F.col("giant.n") / block)
    side = F.when(is_giant, others + F.pmod(F.xxhash64("node"), blocks)).otherwise(F.pmod(F.xxhash64("node"), others)).cast("int")
    many = rest.select("*", side.alias("side"), F.explode(F.sequence(F.lit(0), F.when(is_giant, others - 1).otherwise(others + blocks - 1).cast("int"))).alias("other"))
    many = many.select("shingle", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "root")
    crowds = rest.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("m"), "shingle"))), lambda x: x["shingle"]).alias("crowds"))
    many = many.join(nodes.select("node", "size", "sketch").join(crowds, "node"), "node").withColumn("crowds", F.expr("slice(crowds, 1, cast(array_position(crowds, shingle) as int) - 1)"))
    many = saved(many.groupBy("shingle", "lo", "hi").applyInArrow(_block_pairs(similarity), "shingle long, lo int, hi int, a long, b long, told int"), "many")
    links = links.unionByName(many.where(F.col("told") == SURE).select("a", "b").distinct())
    roots = saved(components(links), "roots")
    open_ = saved(_crossing(many.where((F.col("told") == OPEN) & F.col("b").isNotNull()).select("a", "b").distinct(), roots), "open")
    if open_.limit(1).count():
        links = links.unionByName(saved(exactly_similar(open_, slim, members, nodes, words, similarity), "links"))
    left = many.where("b is null").select("shingle", "lo", "hi", F.col("a").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    crossed = left.groupBy("shingle", "lo", "hi").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("shingle", "lo", "hi")
    left = saved(left.join(crossed, ["shingle", "lo", "hi"], "left_semi"), "left")
    if left.limit(1).count():
        within = left.join(_sets(left.select("node").distinct(), slim, nodes, words), "node")
        links = links.unionByName(saved(within.groupBy("shingle", "lo", "hi").applyInArrow(_block_links(similarity), "a long, b long").distinct(), "links"))
    roots = saved(components(links), "roots")
    at = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = at.join(at.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return even_join(members, named, "node", "left").select(F.col("id").alias(key), "component_id")


def _contested(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(shingle, node, root, giant, m) of the shingles, in met (shingle, node), whose m nodes are of several components; giant: size n and root of the largest one there."""
    rooted = saved(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    giants = rooted.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "root")).alias("giant"), F.sum("n").alias("m")).where("giant.n < m")
    return saved(even_join(rooted, giants, "shingle"), "rest")


def _crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends have different roots. roots: (node, root) of the nodes that have another root than themselves, at least."""
    at = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    return at.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def _sets(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, words: int, most: int = 100_000) -> DataFrame:
    """(node, hashes): the sets of shingles of the nodes wanted (node), a table. texts: (id, text). The ids are sent to the texts
    if they are `most` at most; else both are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row at a time: a very long text's set is as large as the text
                hashes = _shingles(b.column(1)[i].as_py(), words)
                if xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63) == b.column(0)[i].as_py():  # an id may have several texts
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))], names=["node", "hashes"])

    wanted = saved(nodes.select("node", F.col("least").alias("id")).join(wanted, "node", "left_semi"), "wanted")
    rows = texts.join(F.broadcast(wanted) if wanted.count() <= most else wanted, "id").select("node", "text")
    return saved(rows.mapInArrow(tidy(run), "node long, hashes array<long>").dropDuplicates(["node"]), "shingles")


def exactly_similar(pairs: DataFrame, texts: DataFrame, members: DataFrame, nodes: DataFrame, words: int, similarity: float, most: int = 100_000) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have a Jaccard similarity of `similarity` or more. texts: (id, text)."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts, nodes, words, most)
    both = pairs.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(shared >= F.lit(similarity) * (F.size("ha") + F.size("hb") - shared) - 1e-9).select("a", "b")


#: Shingles of the largest sets that are sent whole to a block.
WHOLE = 1 << 15


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many values each two of the sets share, the diagonal apart: products of matrices of 0 and 1, `width` values at a time."""
    n = len(sets)
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, several = np.repeat(np.arange(n), [len(x) for x in sets]), counts[place] > 1
    row, column = row[several], (np.cumsum(counts > 1) - 1)[place[several]]
    order = np.argsort(column, kind="stable")
    row, column, out = row[order], column[order], np.zeros((n, n), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, (at, at + width)))
        dense = np.zeros((n, int(column[part][-1]) + 1 - at), np.float32)
        dense[row[part], column[part] - at] = 1
        out += dense @ dense.T
    return out


def _top(up: dict[int, int], x: int) -> int:
    while x in up:
        x = up[x]
    return x


def pairs_in_block(nodes: list[int], roots: list[int], sides: list[int], sets: list[np.ndarray], sizes: np.ndarray, similarity: float, before: list[np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
    """told() of the pairs of different roots in a block, where there are two sides of one side each. Of SURE pairs only as many as join the roots; then the OPEN ones that still do,
    but for those that have one of the shingles `before` in common: they are told there."""
    n, small = len(nodes), sizes <= SMALL
    apart, verdict = np.zeros((n, n), np.int32), np.full((n, n), OPEN)
    if len(at := np.flatnonzero(~small)):
        wide = np.array([sets[i] for i in at]).view(np.uint64)
        for i, k in enumerate(at):
            apart[k, at] = np.bitwise_count(wide ^ wide[i]).sum(1)
        s = sizes[at].astype(float)
        cosine = np.minimum(similarity / (1 + similarity) * (s[:, None] + s) / np.sqrt(s[:, None] * s), 1)
        middle = np.arccos(cosine) / math.pi * 64 * SKETCH_WORDS
        deviation = np.sqrt(middle * (1 - middle / (64 * SKETCH_WORDS))) + 1
        d = apart[np.ix_(at, at)]
        verdict[np.ix_(at, at)] = np.where(d <= middle - 3.5 * deviation, SURE, np.where(d <= middle + 5 * deviation, OPEN, -1))
    if len(at := np.flatnonzero(small)):
        shared = shared_counts([sets[i] for i in at])
        verdict[np.ix_(at, at)] = np.where(shared >= similarity * (sizes[at][:, None] + sizes[at] - shared) - 1e-6, SURE, -1)
    verdict[np.minimum(sizes[:, None], sizes) < similarity * np.maximum(sizes[:, None], sizes) - 1e-9] = -1
    if len(set(sides)) > 1:
        verdict[np.array(sides)[:, None] == np.array(sides)] = -1
    if before is not None:
        verdict[(verdict == OPEN) & (shared_counts(before) > 0)] = -1
    up: dict[int, int] = {}
    out = []
    for kind in (SURE, OPEN):
        for i, j in np.argwhere(np.triu(verdict == kind, 1)).tolist():
            if (x := _top(up, roots[i])) != (y := _top(up, roots[j])):
                out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), int(apart[i, j]), kind))
                if kind == SURE:
                    up[max(x, y)] = min(x, y)
    return out


def _block_pairs(similarity: float):
    """Of a block, SURE pairs (a, b), OPEN ones with a set of over WHOLE shingles, and as OPEN (a, null) the nodes of all other OPEN pairs."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("node", "root", "side")), range(table.num_rows), strict=True))
        sizes = table.column("size").to_numpy()

        def lists(name: str) -> list[np.ndarray]:
            column = table.column(name).combine_chunks()
            return [column[r[3]].values.to_numpy(zero_copy_only=False) for r in rows]

        nodes, sizes = [r[0] for r in rows], np.array([sizes[r[3]] for r in rows])
        size = dict(zip(nodes, sizes.tolist(), strict=True))
        out, inside = [], set()
        for a, b, _, kind in pairs_in_block(nodes, [r[1] for r in rows], [r[2] for r in rows], lists("sketch"), sizes, similarity, lists("crowds")):
            if kind == SURE or max(size[a], size[b]) > WHOLE:
                out.append((a, b, kind))
            else:
                inside |= {a, b}
        out += [(a, None, OPEN) for a in sorted(inside)]
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        block = [pa.array([table.column(c)[0].as_py()] * len(out), k) for c, k in (("shingle", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()))]
        return pa.table([*block, *columns], names=["shingle", "lo", "hi", "a", "b", "told"])

    return run


def links_in_block(nodes: list[int], roots: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (a, b) of `similarity` or more, counted, as many as join the nodes' roots."""
    sizes, shared = np.array([len(x) for x in sets]), shared_counts(sets)
    similar = shared >= similarity * (sizes[:, None] + sizes - shared.astype(float)) - 1e-9
    similar &= np.array(roots)[:, None] != np.array(roots)
    up: dict[int, int] = {}
    out = []
    for i, j in np.argwhere(np.triu(similar, 1)).tolist():
        if (x := _top(up, roots[i])) != (y := _top(up, roots[j])):
            out.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
            up[max(x, y)] = min(x, y)
    return out


def _block_links(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        sets = table.column("hashes").combine_chunks()
        out = links_in_block(table.column("node").to_pylist(), table.column("root").to_pylist(), [x.values.to_numpy(zero_copy_only=False) for x in sets], similarity)
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("a", "b"))})

    return run


def keep_representatives(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group: that whose key is the component's id. Of a key's repeated rows those with another text stay too, of
    equal ones the first by a hash of all columns. Rows without a key can't be named by a class, and stay."""
    kept = saved(classes.where(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count("*").alias("_rows")), "kept")
    # A row for each document kept: it grows with the corpus, so it is never sent whole.
    out = docs.join(kept.select(key).hint("merge"), key, "left_semi")
    if kept.where("_rows > 1").limit(1).count():
        single = docs.join(kept.where("_rows = 1").select(key), key, "left_semi")
        first = Window.partitionBy(key, text).orderBy(F.xxhash64(*docs.columns))
        repeated = docs.join(kept.where("_rows > 1").select(key), key, "left_semi").withColumn("_place", F.row_number().over(first)).where("_place = 1")
        out = single.unionByName(repeated.drop("_place"))
    return out.unionByName(docs.where(F.col(key).isNull()))
