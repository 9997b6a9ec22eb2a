"""The operators against brute force and on odd rows: nulls, empty tables, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import chat, common, html_extract, media, mixing, sharding, simhash, topk, toxicity, url_filter
from weftgraph.operators import storage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "Same text here", "en", "a", 14), (4, "Same text here", "en", "b", 14), (4, "Same text here", "en", "b", 14), (None, "no key", "en", None, 6), (6, LONG, "en", "c", len(LONG)), (7, " \n\t ", "en", "c", 4)]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("clash"), "id": F.lit(1), "shard": F.lit(2), "position": F.lit(0)})


# Each operator over documents, with its number of rows: all of them.
OVER_DOCS = {
    "shards": lambda d: sharding.hash_tree_shards(d),
    "mix": lambda d: mixing.curriculum_mix(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "streams": lambda d: media.read_streams(media.write_streams(d), keep=("n_bytes",)),
}


@pytest.mark.parametrize("name", OVER_DOCS)
def test_odd_and_empty(spark, name):
    assert OVER_DOCS[name](odd(spark)).count() == len(ODD)
    assert OVER_DOCS[name](odd(spark, [])).count() == 0


def test_shards_by_brute_force(spark):
    rows = [(i, f"text {i % 50}", "en", "s", 7) for i in range(3000)]
    got = {r.doc_id: r for r in sharding.hash_tree_shards(spark.createDataFrame(rows, DOCS), rows_per_bucket=32).collect()}

    def draw(key, level, child, weight):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        for x in (level, child):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
        return -math.log(((h >> 12) + 0.5) / (1 << 52)) / weight

    def place(key, node, level=0):
        total = lambda n: sum(map(total, n.values())) if isinstance(n, dict) else n
        child = min(node, key=lambda c: draw(key, level, c, total(node[c])))
        return place(key, node[child], level + 1) if isinstance(node[child], dict) else child

    def filled(key, n):
        drawn = []
        for r, racks in sharding.tree(-(-n // 8) * 8).items():
            drawn.append((draw(key, 0, r, 8.0), place(key, racks, 1)))
        hits = [x for x in drawn if x[1] < n]
        return min(hits)[1] if hits else min((draw(key, 3, i, 1.0), i) for i in range(n))[1]

    for i in range(3000):
        text = rows[i][1].encode()
        r = got[i]
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.shard == filled(i, 16) == place(i, sharding.tree(16)) and r.grown_shard == filled(i, 17)
        assert r.grown_shard in (r.shard, 16)
    assert sum(r.grown_shard == 16 for r in got.values()) > 90
    for s in range(16):
        assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(sum(r.shard == s for r in got.values())))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """From any number of shards; and a row that is repeated very often is dealt out over slots."""
    ns = [1, 2, 3, 7, 8, 11, 12, 15, 16, 17, 23, 24]
    at = spark.range(2000).select(*[sharding.filled_shard_of(F.col("id"), n).alias(f"s{n}") for n in sorted({*ns, *(n + 1 for n in ns)})]).collect()
    for n in ns:
        assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) for r in at) and {r[f"s{n}"] for r in at} == set(range(n))
    docs = spark.createDataFrame([(None, "x", "en", "a", 1)] * 500 + [(i, "x", "en", "a", 1) for i in range(50)], DOCS)
    out = sharding.hash_tree_shards(docs, 4, rows_per_bucket=16).collect()
    assert len(out) == 550 and len({(r.shard, r.slot) for r in out}) == 550
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    grown = {r.doc_id: r.grown_shard for r in out}
    assert grown == {r.doc_id: r.shard for r in sharding.hash_tree_shards(docs, 5).collect()}


def test_weights_confine_movement(spark):
    ids = spark.range(4000)
    before = sharding.shard_of(F.col("id"), sharding.tree(16))
    after = sharding.shard_of(F.col("id"), sharding.tree(16, weights={5: 2.0}))
    moved = ids.select(before.alias("a"), after.alias("b")).where("a != b").collect()
    # Region 0 with shards 0 to 7 gains; within region 1 nothing moves.
    assert moved and all(r.b < 8 for r in moved)
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), {0: {0: {0: 0.0}}})


def url_brute(url, rules, default="allow"):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, default))


def test_urls_by_brute_force(spark):
    random.seed(5)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("example.com", "/en/a", "allow"), ("example.com", "/en/ab", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "", "allow"), ("", "/x", "block"), ("a.net", "/é", "block")]
    hosts = ["com", "example.com", "WWW.Example.com", "notexample.com", "net", "a.net", "b.a.net", "", "org", "É.com", "a..com"]
    paths = ["", "/", "/en", "/en/", "/en/a", "/en/ab/c", "/en/b?x=/es/", "/es/#f", "/x", "/é?", "/\U0010ffff"]
    urls = [None, "", "no scheme/en/", "://", "http://", "a://b://com/en/"] + [f"http://{random.choice(hosts)}{random.choice(paths)}" for _ in range(600)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, key int")
    got = {r.page_id: (r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in url_filter.url_filter(pages, spark.createDataFrame([*rules, (None, "/", "block"), rules[0]], url_filter.RULES), ranges=7).collect()}
    assert got == {i: url_brute(u, rules) for i, u in enumerate(urls)}
    none = url_filter.url_filter(pages, spark.createDataFrame([], url_filter.RULES), default="block")
    assert {r.url_verdict for r in none.collect()} == {"block"} and none.count() == len(urls)
    assert url_filter.url_filter(pages.limit(0), spark.createDataFrame(rules, url_filter.RULES)).count() == 0


def test_urls_of_nested_hosts_and_long_paths(spark):
    random.seed(6)
    labels, parts = ["a", "b", "com", "x-y"], ["/", "/a", "/a/b", "/é/", "/" + "p" * 2000]
    host = lambda n: ".".join(random.choices(labels, k=n))
    path = lambda n: "".join(random.choices(parts, k=n))
    rules = list({(h, p): (h, p, random.choice(["allow", "block"])) for h, p in ((host(random.randint(1, 5)), path(random.randint(0, 3))) for _ in range(120))}.values())
    urls = [f"https://{host(random.randint(1, 6))}{path(random.randint(0, 4))}" for _ in range(500)] + ["https://com/"] * 300 + ["none"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in url_filter.url_filter(pages, spark.createDataFrame(rules, url_filter.RULES), ranges=11).collect()}
    for i, u in enumerate(urls):
        want = url_brute(u, rules)
        assert got[i][:2] == want[:2] and got[i][3] == want[3] and (got[i][2] is None) == (want[2] is None) and len(got[i][2] or "") == len(want[2] or "")


def fingerprint_brute(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_by_brute_force(spark, sf):
    random.seed(1)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = docs[3][1].split()
    docs += [(10_000 + i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(random.sample(range(len(base)), min(40, len(base))))]
    docs += [(20_000, None), (20_001, ""), (20_002, "one"), (20_003, "One"), (-5, docs[0][1])]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    prints = {i: fingerprint_brute(t) for i, t in docs}
    assert {i: r.fingerprint % (1 << 64) for i, r in got.items()} == prints
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2 and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in ids}
    assert len({r.component_id for r in got.values()}) < len(got) - 3


def test_components_of_chains_and_stars(spark):
    random.seed(2)
    chain = list(range(200))
    random.shuffle(chain)
    links = [(-x - 1, -y - 1) for x, y in zip(chain, chain[1:])] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 8), (8, 7)]
    got = dict(simhash.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert all(got[-x - 1] == -200 for x in chain) and all(got[1000 + i] == 1000 for i in range(300)) and got[8] == got[7] == 7
    with pytest.raises(ValueError):
        simhash.ball_links(spark.createDataFrame([(1,)], "fingerprint long"), 3)


def test_few_links_are_joined_in_one_task(spark):
    """By plans, too, components leave one table; arrays spare all rounds, and give the same."""
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(-(2**63), -1) >> rng.choice((0, 57)), rng.randint(100, 180)) for _ in range(120)] + [(7, 7), (None, 3)]
    table = spark.createDataFrame(links, "a long, b long").repartition(5)
    up = {}
    for a, b in links[:-1]:
        x, y = simhash._top(up, a), simhash._top(up, b)
        if x != y:
            up[max(x, y)] = min(x, y)
    want = sorted((n, simhash._top(up, n)) for n in {x for ab in links[:-1] for x in ab})
    folder = Path(storage.shared_dir(spark).removeprefix("file://"), "weft")
    tables = lambda: {p.name for p in folder.glob("links-*")} if folder.exists() else set()
    group = spark.sparkContext
    jobs = {}
    for few in (None, 50, 0):
        was = tables()
        group.setJobGroup(f"few {few}", "")
        assert sorted(map(tuple, simhash.components(table, few=few).collect())) == want
        jobs[few] = len(group.statusTracker().getJobIdsForGroup(f"few {few}"))
        assert len(tables() - was) == 1
    group.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[None] <= 6 < 20 < jobs[0]
    assert simhash.components(table.limit(0)).count() == simhash.components(table.limit(0), few=-1).count() == 0


def test_least_reached():
    """By arrays, as by one link after the other."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, m = rng.integers(1, 40), rng.integers(0, 40)
        u, v, up = rng.integers(-n, n, m), rng.integers(-n, n, m), {}
        for a, b in zip(u.tolist(), v.tolist()):
            if (x := simhash._top(up, a)) != (y := simhash._top(up, b)):
                up[max(x, y)] = min(x, y)
        nodes, roots = simhash.least_reached(u, v)
        assert dict(zip(nodes.tolist(), roots.tolist())) == {x: simhash._top(up, x) for x in {*u.tolist(), *v.tolist()}}
    n = 1 << 17  # a long chain in any order takes few turns
    assert (simhash.least_reached(np.arange(1, n), np.arange(n - 1))[1] == 0).all()


def test_representatives(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (1, "a b c d"), (3, "other words are here"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in simhash.keep_representatives(docs, simhash.near_duplicates(docs)).collect()) == [-1, 1, 3]


def test_mix_by_brute_force(spark):
    random.seed(3)
    rows = [(i, " ".join(["w"] * random.choice([0, 1, 5, 40])), "en", random.choice(["a", "b", "ß", "c", None, *["hot"] * 6]), 0) for i in range(800)]
    got = mixing.curriculum_mix(spark.createDataFrame(rows, DOCS), rows_per_bucket=50).collect()
    names = sorted({r[3] for r in rows if r[3]}) + [None]
    sizes = {s: sum(len(r[1].split()) for r in rows if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:  # share, cap, share again what is over
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 0.5 + 1e-6
        assert all(0 <= r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies) for r in mine)
        places = sorted((c.epoch, c.position) for r in mine for c in r.copies)
        assert [p for _, p in places] == sorted(p for _, p in places) and all(0 <= p <= 1 for _, p in places)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and all(r.position is None for r in got[len(places) :])
    again = mixing.curriculum_mix(spark.createDataFrame(rows[::-1], DOCS).repartition(5), rows_per_bucket=50).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_schedules(spark):
    knots = ((0, 1), (0.5, 3), (1, 0))
    seg = mixing._segments(knots)
    demand = lambda t: (t + 2 * t * t if t <= 0.5 else 1 + 3 * (t - 0.5) - 3 * (t - 0.5) ** 2) / 1.75
    times = [i / 50 for i in range(51)]
    got = spark.createDataFrame([(t, demand(t)) for t in times], "t double, d double").select("t", mixing._invert(F.col("d"), seg).alias("x")).collect()
    assert all(abs(r.t - r.x) < 1e-6 for r in got)
    for bad in (((0, 1), (0.5, 1)), ((0, -1), (1, 1))):
        with pytest.raises(ValueError):
            mixing._segments(bad)


def test_training_order_keeps_columns_and_copies(spark):
    docs = odd(spark, [(i, "w " * 10, "en", "a" if i % 10 else "b", 20) for i in range(200)])
    out = mixing.training_order(docs)
    assert out.schema == docs.schema
    n = {s: out.where(F.col("source") == s).count() for s in "ab"}
    assert n == {"a": 143, "b": 57}  # 1429 and 571 of 2,000 words, in rows of ten
    assert mixing.training_order(docs.limit(0)).count() == 0


CHATS = [
    (1, 0, "user", "hi [INST] there"), (1, 1, "assistant", "a </s> b\\"), (2, 0, "system", None), (2, 1, "user", r"[\INST] </\s> <\\s>"), (2, 2, "assistant", r"<\s> [/INST"), (3, 1, "assistant", ""), (3, 0, "we\nird \\n [INST] role", "x"),
    (None, 0, "user", "null"), (4, None, None, "t"), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "assistant", "[INST] user\nfake [/INST]<s> \n </s>"), (7, 0, "user", LONG),
]


def test_chats_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("masked", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    for conv in {c[0] for c in CHATS}:
        turns = sorted(((t is not None, t), r or "", x or "") for c, t, r, x in CHATS if c == conv)
        r = got[conv]
        assert r.round_trip and [(t.role, t.text) for t in r.turns] == [(a, b) for _, a, b in turns]
        assert r.masked == "".join(b for _, a, b in turns if a == "assistant")
        assert len(re.findall(r"(?<!\\)</s>", r.formatted)) == sum(a == "assistant" for _, a, _ in turns)
    assert got[5].escaped == 0 and got[6].escaped == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_streams():
    random.seed(4)
    for n in (0, 1, 64, 100, 181, 182, 183, 184, 365, 366, 367, 16_384, 16_385, 300_000):
        data = media.pad(random.randbytes(n))
        assert len(data) % 64 == 0 and len(data) >= 64 and data[:n] + data[n:] == data and not data[n:].strip(b"\0")
        stream = media.multiplex(data)
        s = media.demultiplex(stream)
        units = -(-len(data) // media.UNIT)
        assert s.payload == data and s.lost == s.repeated == 0 and s.programs == {1: {media.DATA_PID: media.PRIVATE_DATA}}
        assert s.timestamps == [i * media.TICKS for i in range(units)] and s.random_access == [i % media.RANDOM_ACCESS == 0 for i in range(units)]
        assert s.offsets == [i * media.UNIT for i in range(units)]
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert media.demultiplex(b"".join([*packets[:9], packets[8], *packets[9:]])).repeated == 1
    assert media.demultiplex(b"".join([*packets[:9], packets[8], *packets[9:]])).payload == data
    cut = media.demultiplex(b"".join([*packets[:9], *packets[10:]]))
    assert cut.lost == 1 and cut.missing == 184 and len(cut.payload) == len(data) - 184
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + bytes(184)
    assert media.demultiplex(b"".join([null, *packets])).payload == data
    for bad in (b"", b"x" * 188, stream[:-1], stream[188:], bytes([*stream[:10], stream[10] ^ 1, *stream[11:]])):
        with pytest.raises(ValueError):
            media.demultiplex(bad)


def test_stream_columns(spark):
    out = {r.doc_id: r for r in media.read_streams(media.write_streams(odd(spark)), keep=("n_bytes",)).collect()}
    for i, text, *_ in ODD:
        data = media.pad((text or "").encode())
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len((text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert out[3].media_sha256 == out[4].media_sha256
    bad = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert [(r.error is None, r.payload_bytes) for r in media.read_streams(bad).orderBy("doc_id").collect()] == [(False, None), (True, None)]


def test_streams_come_in_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 1000 * i) for i in range(20)] + [(None, None)], "doc_id long, text string").coalesce(1)
    batches = docs.toArrow().to_batches()
    monkeypatch.setattr(media, "BATCH_BYTES", 10_000)
    got = list(media._streams(iter(batches)))
    assert all(sum(map(len, m[:-1])) < 10_000 for _, _, m in got) and sum(len(m) for _, _, m in got) == 21
    apart = media.read_streams(media.write_streams(docs), keep=("n_bytes",))
    both = media.stream_features(docs)
    assert both.columns == apart.columns and sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))


def test_top_k_by_brute_force(spark):
    random.seed(6)
    rows = [(i, [random.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [9.0] * 8), (2050, []), (2051, [5.0]), (100, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(0), "x": F.lit(0)}).repartition(5)
    stored = [(r.vec_id, [math.floor(256 * x) for x in r.embedding]) for r in df.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = []
    for i, v in stored:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in stored if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    for block in (4, 2048):
        assert sorted(map(tuple, topk.top_k(df, block=block).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 1")).count() == 0 and topk.top_k(df.where("vec_id in (0, 1, 2)")).count() == 2


def test_pivots_eliminate():
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.integers(-256, 256, (40, 16))
    v = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 8, (4000, 16))).astype(float)
    s = topk.PivotSearch(np.arange(20), v[:20], v[rng.choice(4000, 32, False)], 5)
    s.add(np.arange(4000), v, s.distances(v))
    for q in range(20):
        scores = v @ v[q]
        want = sorted((-int(x), j) for j, x in enumerate(scores) if j != q)[:5]
        assert [(-int(a), int(b)) for b, a in zip(*s.best[q])] == want
    assert s.evaluated < 0.5 * 20 * 4000


def test_large_components(spark):
    big = [(0, [3e15, 1.0]), (1, [2e15, -1.0]), (50, [1.0, 2.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(big, "vec_id long, embedding array<float>")).collect()}
    assert got[0, 1] == (1, (1 << 63) - 1) and got[50, 1][0] == 0


def test_components_beyond_a_long(spark):
    """Products of components that a double or a long doesn't hold are summed as whole numbers, then held to a long."""
    rows = [(0, [256e18, 1.0, 3.0]), (1, [-256e18, 2.0, 0.0]), (2, [2.0**-40, 5.0, 1.0]), (3, [1e200, -1e200, 0.0]), (50, [1.0, 2.0, 0.5])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id, r.vec_id] = r.score
    for q in (0, 50):
        for i, v in rows:
            if i != q:
                want = sum(math.floor(a * 256) * math.floor(b * 256) for a, b in zip(dict(rows)[q], v))
                assert got[q, i] == max(-(1 << 63), min((1 << 63) - 1, want))


def page(article, before="", after=""):
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>{before}{article}{after}</body></html>"


SIDE = '<nav><ul><li><a href="/">Home</a><li><a href="/x">More</a></ul></nav><div class="cookie-notice">We use cookies</div>'
TAIL = '<section id="comments"><p>First!</p></section><aside>Related</aside><form><p>Join</p></form><footer>&copy; us</footer>'


def test_pages(spark):
    rows = [(i, f"http://h.org/{i}", page(f"<article><h1>Title&nbsp;{i}</h1><p>a<b>b</b>c &amp; d<br>e\n  f<script>var x='</p>'</script><div class='share'>tweet</div><p>same end</article>", SIDE, TAIL)) for i in range(6)]
    want = {i: f"Title {i} abc & d e f same end" for i in range(6)}
    rows += [(10 + i, f"http://plain.org/{i}", page(f'<div class="wrap"><div id="x1"><h2>Head {i}</h2><p>{"long text " * 20}{i}</p><p>x &lt; y{i}</p></div><div class="sidebar">Links</div></div>', SIDE, TAIL)) for i in range(4)]
    want |= {10 + i: " ".join([f"Head {i}", *["long text"] * 20, str(i), f"x < y{i}"]) for i in range(4)}
    rows += [(20, "http://one.org/", page("<main><p>only</p></main>", SIDE)), (21, None, None), (22, "x", ""), (23, "http://h.org/a", "<p>loose <b>text"), (24, "http://h.org/b", "<article><p>cut <a href='x"), (25, "http://t.org/", "no markup & such"), (20, "http://one.org/", page("<main><p>only</p></main>", SIDE))]
    want |= {20: "only", 21: "", 22: "", 23: "loose text", 24: "cut", 25: "no markup & such"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(0), "host": F.lit("clash"), "text": F.lit("x")})
    got = html_extract.extract_pages(df).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    t = {r.host: r for r in html_extract.templates(df).collect()}
    assert t["h.org"].name == "article" and t["h.org"].classes >= 2 and t["plain.org"].name == "div.x1"
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_template_text_goes_and_own_text_stays(spark):
    """Text without a telling name that all pages of a host have is the template's; names that could be an article's own tell nothing by themselves."""
    letter = "<div class='x7'>Get our daily letter, free of charge</div>"
    rows, want = [], {}
    for i in range(8):
        body = f"<div class='post-header'><h1>Head {i}</h1></div><p>{'word ' * 20}{i}</p>{letter}<p class='market-share'>share {i}</p><h2 id='related-work'>Related {i}</h2>"
        own = f"Head {i} {'word ' * 20}{i} share {i} Related {i}"
        if i == 3:
            body += "<section id='discussion'><p>We discuss this</p></section>"
            own += " We discuss this"
        if i > 2:
            body += "<div id='legal-links'>Terms</div><div class='share'>tweet</div>"
        rows.append((i, f"http://h.org/{i}", page(f"<div class='post'>{body}</div>")))
        want[i] = own
    plain = [(10 + i, f"http://plain.org/{i}", f"<body><div class='a1'>Home About</div><div class='b2'><p>{'text ' * 30}{i}</p><div class='c3'>Made by us</div></div><div class='c4'>{'all rights ' * 4}</div></body>") for i in range(6)]
    copies = [(20 + i, f"http://copy.org/{i}", page("<article><p>one and the same text</p></article>")) for i in range(6)]
    want |= {10 + i: "text " * 30 + str(i) for i in range(6)} | {20 + i: "one and the same text" for i in range(6)}
    got = html_extract.extract_pages(spark.createDataFrame(rows + plain + copies, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_templates_by_brute_force(spark):
    """Classes of equal occurrence vectors, on most pages, in one order on each."""
    rng = random.Random(21)
    rows = []
    for i in range(60):
        parts = [f"<div class='k{j}'>{rng.choice(['fixed ' + str(j), 'own ' + str(i)])}</div>" * rng.randint(1, 2) for j in range(4)]
        parts += [f"<p class='m{j}'>always {j}</p>" for j in range(3)]
        if i % 12 < 6:
            rng.shuffle(parts)  # hosts of even number: order differs from page to page
        rows.append((i, f"http://h{i % 12}.org/{i}", f"<body>{''.join(parts)}</body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r for r in html_extract.templates(df).collect()}
    for h in range(12):
        pages = [html_extract.read_page(x) for _, u, x in rows if u.startswith(f"http://h{h}.org/")]
        vectors = {}
        for k, p in enumerate(pages):
            for t in p.tokens:
                vectors.setdefault((t.id, False), [0] * len(pages))[k] = t.count
            for _, i, _ in p.blocks:
                vectors.setdefault((i, True), [0] * len(pages))[k] += 1
        classes = {}
        for (i, block), v in vectors.items():
            n = sum(x > 0 for x in v)
            if 2 * n >= len(pages) and (not block or n >= 4):
                classes.setdefault(tuple(v), set()).add((i, block))
        valid = []
        for c in classes.values():
            runs = [[i for i in p.sequence if (i, True) in c or (i, False) in c] for p in pages]
            orders = {tuple(dict.fromkeys(r)) for r in runs if r}
            if any(not b for _, b in c) and (len(c) == 1 or len(orders) == 1 and all(r == list(*orders) * (len(r) // len(*orders)) for r in runs if r)):
                valid.append(c)
        assert got[f"h{h}.org"].classes == len(valid) and got[f"h{h}.org"].tokens == sum(map(len, valid))
        assert set(got[f"h{h}.org"].texts) == {i for c in valid for i, block in c if block}


def test_deep_and_broken_pages():
    """Time and memory that grow with the page: unclosed, unopened and crossed tags by the hundred thousand."""
    n, began = 100_000, time.time()
    deep = html_extract.read_page("<div>" * n + "text")
    assert len(deep.tokens) == n + 1 and html_extract.extract(deep) == "text"
    for html in ("<div>x" * n, "<b>" * n + "x" + "</i>" * n, "<i><div>" + "<b>" * n + "x" + "</i>" * n, "<span>" * n + "<p>x" * n, "<ul>" + "<li><b>x" * n, "</div>x" * n, "<td>x" * n, "<p class='a b' id=c>x</p>" * n):
        assert html_extract.extract(html_extract.read_page(html)).replace(" ", "").count("x") == html.count("x")
    assert time.time() - began < 60


def test_block_max_is_exact():
    rng = random.Random(7)
    vectors = []
    for _ in range(500):
        v = {t: rng.random() for t in sorted({int(30 * rng.random() ** 2) for _ in range(rng.randint(1, 6))})}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    vectors.sort(key=lambda v: max(v, key=v.get))
    arrays = [(np.array(list(v)), np.array(list(v.values()))) for v in vectors]
    index = toxicity.BlockMaxIndex(arrays, 30, block=16)
    asked = [*arrays[::8], (np.zeros(0, np.int64), np.zeros(0))]
    found = index.nearest(np.concatenate([t for t, _ in asked]), np.concatenate([w for _, w in asked]), np.cumsum([0, *(len(t) for t, _ in asked)]), 7)
    assert len(found[-1][0]) == 0 and 0 < len(index.table) < 30
    for q, (similar, ids) in zip(vectors[::8], found):
        scores = [(round(sum(q[t] * v.get(t, 0) for t in q), 9), i) for i, v in enumerate(vectors)]
        want = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1]))[:7]
        assert ids.tolist() == [w[1] for w in want] and all(abs(g - w[0]) < 1e-8 for g, w in zip(similar, want))
    assert index.visited < 0.8 * len(vectors[::8]) * index.n_blocks


def test_toxicity_by_brute_force(spark):
    """Document frequencies, relevance, cosine, votes and calibration, each written out."""
    rng = random.Random(22)
    words = ["alpha", "beta", "gammatone", "deltas", "rotten", "rottenly", "of", "the"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))) + f" own{i}" * (i % 3)) for i in range(120)]
    labels = [(i, int("rotten" in t and rng.random() < 0.9)) for i, t in docs if i % 2]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), k=5)
    counts = {i: toxicity.term_counts(t) for i, t in docs}
    assert toxicity.term_counts("Rottenly, (\u00c9COLE) x_1 x_1") == {"rottenly": 1, "rott-": 1, "rotte-": 1, "école": 1, "écol-": 1, "x_1": 2} and toxicity.term_counts(None) == {}
    texts = pa.array([t for _, t in docs] + [None, "", "zeta " * 3000], pa.string())
    known = sorted({t for c in counts.values() for t in c} - {"deltas"})
    terms, n, starts = toxicity.read_terms(texts, pa.array(known))
    for i, (_, t) in enumerate(docs):
        at = slice(starts[i], starts[i + 1])
        assert {known[x]: c for x, c in zip(terms[at], n[at])} == {x: c for x, c in counts[docs[i][0]].items() if x != "deltas"}
    assert starts[-1] == starts[-4] and list(toxicity.slices(texts, 50, 400))[-1][1] == len(texts)
    label = dict(labels)
    ids = model.ids.tolist()
    n = [sum(label[i] == v for i in ids) for v in (0, 1)]
    total = [sum(v == y for _, v in labels) for y in (0, 1)]

    def weight(t):
        ones, zeros = (sum(t in counts[i] for i in ids if label[i] == v) for v in (1, 0))
        idf = math.log((1 + len(docs)) / (1 + sum(t in c for c in counts.values()))) + 1
        return idf * math.log2(2 + max(ones - 1, 0) / max(zeros * n[1] / n[0], 1))

    known = {t for i in ids for t in counts[i]}
    weights = {t: weight(t) for t in known}

    def vector(i):
        v = {t: weights[t] * (1 + math.log(c)) for t, c in counts[i].items() if t in known}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    rate = (total[1] + 0.5) / (sum(total) + 1)

    def vote(i, without=None):
        v = vector(i)
        near = sorted((-round(sum(x * e.get(t, 0) for t, x in v.items()), 9), k) for k, e in enumerate(map(vector, ids)) if ids[k] != without)
        votes, whole, used = rate, 1.0, []
        for s, k in [x for x in near if x[0] < 0][:5]:
            w = total[label[ids[k]]] / n[label[ids[k]]] / (1.1 - min(-s, 1))
            votes, whole = votes + w * label[ids[k]], whole + w
            used.append(ids[k])
        return votes / whole, used

    knots = toxicity._isotonic(np.array([vote(i, i)[0] for i in ids]), np.array([label[i] for i in ids]), np.array([total[label[i]] / n[label[i]] for i in ids]))
    assert np.allclose(model.knots, knots)
    for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect():
        want, used = vote(r.doc_id)
        assert abs(r.score - np.interp(want, *knots)) < 1e-6 and [e.doc_id for e in r.evidence] == used


def test_toxicity(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, toxicity.learnable(labels))
    held = labels.join(toxicity.learnable(labels), "doc_id", "left_anti")
    rows = toxicity.score(docs, model).join(held, "doc_id").collect()
    ranked = sorted((r.score, r.toxic) for r in rows)
    ones = sum(t for _, t in ranked)
    above = sum(sum(1.0 if a < s else 0.5 if a == s else 0.0 for a, y in ranked if not y) for s, t in ranked if t)
    auc, accuracy = above / ones / (len(ranked) - ones), sum(r.predicted == r.toxic for r in rows) / len(rows)
    # Measured once, with settings chosen on folds of the other rows: 90 of 97 held-out texts of label 1 found, 1 of 728 others rejected, AUC 0.989.
    assert ones > 50 and auc > 0.95 and accuracy > 0.97, (auc, accuracy)
    assert abs(sum(r.score for r in rows) / len(rows) - ones / len(rows)) < 0.03


def test_toxicity_on_odd_rows(spark):
    labels = spark.createDataFrame([(2, 1), (3, 0), (3, 1), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd(spark), labels)
    out = toxicity.score(odd(spark), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.reject(odd(spark), model).schema == odd(spark).schema
    empty = toxicity.fit(odd(spark, []), labels.limit(0))
    assert toxicity.score(odd(spark, []), empty).count() == 0 and toxicity.reject(odd(spark), empty).count() in (0, len(ODD))


def test_similar_documents(spark):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    base = [[word() for _ in range(200)] for _ in range(30)]
    rows, near = [], {}
    for i, b in enumerate(base):
        rows.append((i, " ".join(b)))
        for c in range(3):
            copy = list(b)
            for k in random.sample(range(200), 2):
                copy[k] = word()
            near[100 + 10 * i + c] = i
            rows.append((100 + 10 * i + c, " ".join(copy).upper()))
        half = b[:100] + [word() for _ in range(100)]
        rows.append((1000 + i, " ".join(half)))
    rows += [(2000, None), (2001, ""), (None, rows[0][1]), (2002, rows[0][1])]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and got[2000] == got[2001] == 2000 and got[2002] == 0
    assert sum(got[k] == i for k, i in near.items()) >= 0.95 * len(near)
    assert all(got[1000 + i] == 1000 + i for i in range(30))
    assert simhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_documents_by_brute_force(spark):
    """Copies of similarities around the bound: groups are those of the exact similarity."""
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    texts = {}
    for i in range(20):
        base = [word() for _ in range(200)]
        texts[10 * i] = base
        for c in range(1, 5):
            texts[10 * i + c] = list(base)
            for k in random.sample(range(200), 2 * c):
                texts[10 * i + c][k] = word()
    sets = {k: {tuple(t[j : j + 5]) for j in range(196)} for k, t in texts.items()}
    root = {k: k for k in texts}
    pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    for _ in range(10):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    rows = [(k, " ".join(t)) for k, t in texts.items()]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(root[k] <= v for k, v in got.items())  # nothing is joined that shouldn't be
    assert sum(got[k] == root[k] for k in got) >= 0.95 * len(got)


def _groups(texts, words=5, similarity=0.8):
    """The smallest key that each text reaches by exact similarities."""
    sets = {k: {tuple(t[j : j + words]) for j in range(max(1, len(t) - words + 1))} for k, t in texts.items()}
    root = {k: k for k in texts}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 5 * similarity * len(sets[a] | sets[b]) - 1e-9]
    for _ in range(len(texts)):
        was = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == was:
            return root
    return root


def _similar(spark, texts, **options):
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_documents(df, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"crowd": 2, "block": 16}])
def test_similar_documents_in_a_crowd(spark, options):
    """Texts with a long passage in common are not similar by it; the pairs among them that are, all are found."""
    random.seed(10)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    passage, texts = [word() for _ in range(130)], {}
    for i in range(200):
        own = [word() for _ in range(70)]
        texts[i] = passage + own
        if i % 4 == 0:
            texts[1000 + i] = passage + own[:50] + [word() for _ in range(20)]
    want = _groups(texts)
    assert sum(want[k] != k for k in want) == 50 and _similar(spark, texts, **options) == want
    sets = [simhash._shingles(" ".join(t), 5) for t in texts.values()]
    found = simhash.pairs_in_block(list(texts), list(texts), [0] * len(texts), [simhash.sketch(x) for x in sets], np.array([len(x) for x in sets]), 0.8)
    told = {(a, b): kind for a, b, _, kind in found}
    assert {(i, 1000 + i) for i in range(0, 200, 4)} <= set(told) and all(want[b] == a for (a, b), kind in told.items() if kind == simhash.SURE)
    assert len(told) < len(texts) ** 2 / 4  # those that share the passage only mostly go by their sketches


def test_blocks_of_a_crowd_give_links(monkeypatch):
    """Texts of just under the bound to each other, whose sketches tell nothing: a block gives its nodes, not their pairs, and then no more links than join them."""
    import pyarrow as pa

    random.seed(17)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    passage = [word() for _ in range(130)]
    texts = {i: passage + [word() for _ in range(20)] for i in range(60)}
    texts |= {60 + i: texts[i][:-4] + [word() for _ in range(4)] for i in range(5)}
    sets = [simhash._shingles(" ".join(t), 5) for t in texts.values()]
    n, want = len(texts), _groups(texts)
    found = simhash.links_in_block(list(texts), list(texts), sets, 0.8)
    assert found == [(k, r) if k < r else (r, k) for r, k in sorted((r, k) for k, r in want.items() if k != r)] and len(found) == 5
    block = lambda crowds: pa.table({"shingle": [7] * n, "lo": pa.array([0] * n, pa.int32()), "hi": pa.array([0] * n, pa.int32()), "side": [0] * n, "node": list(texts), "root": list(texts), "size": [len(x) for x in sets], "sketch": [simhash.sketch(x) for x in sets], "crowds": pa.array([crowds] * n, pa.list_(pa.int64()))})
    got = simhash._block_pairs(0.8)(block([])).to_pylist()
    assert len(got) <= 2 * n and {r["a"] for r in got} == set(texts) and all(r["b"] is None for r in got if r["told"] == simhash.OPEN)
    assert not [r for r in simhash._block_pairs(0.8)(block([5])).to_pylist() if r["told"] == simhash.OPEN]  # told on the shingle before
    monkeypatch.setattr(simhash, "WHOLE", 10)  # sets too large to be sent to blocks
    pairs = {(r["a"], r["b"]) for r in simhash._block_pairs(0.8)(block([])).to_pylist()}
    assert set(found) <= pairs and None not in {b for _, b in pairs}


def test_shared_counts():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(-40, 40, rng.integers(0, 30))) for _ in range(25)] + [np.array([1 << 62])]
    got = simhash.shared_counts(sets, width=7)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(26) for j in range(26) if i != j)


def test_similar_documents_of_mixed_sizes(spark):
    """Sets around the size up to which they are their own sketch; a group much like each other, a chain of edits, and strangers."""
    random.seed(13)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    texts = {}
    for i in range(40):
        base = [word() for _ in range(random.randint(55, 85))]
        texts[10 * i], texts[10 * i + 1] = base, base + [word() for _ in range(random.randint(0, 16))]
    base = [word() for _ in range(150)]
    for i in range(60):
        texts[5000 + i] = base[: i * 2] + [word()] + base[i * 2 + 1 :]
    chain = [word() for _ in range(400)]
    for i in range(12):
        texts[7000 + i] = chain
        chain = chain[30:] + [word() for _ in range(30)]
    want = _groups(texts)
    assert sum(want[k] != k for k in want) > 80 and _similar(spark, texts) == want


def test_sketches_follow_the_angle():
    rng = np.random.default_rng(3)
    n, apart = 400, []
    for _ in range(60):
        both, one, two = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (n, n // 8, n // 8))
        a, b = simhash.sketch(np.concatenate([both, one])), simhash.sketch(np.concatenate([both, two]))
        apart.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
    assert abs(np.mean(apart) - math.acos(8 / 9) / math.pi * 512) < 4
    assert max(apart) < 77.6 + 5 * 9.1


def test_even_join_by_brute_force(spark):
    rows = [(7, i) for i in range(3000)] + [(950, i) for i in range(3000)] + [(i, i) for i in range(1000)] + [(None, 1)] * 2000
    left, right = common.saved(spark.createDataFrame(rows, "k long, x long"), "t"), spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    for how, dropped in (("inner", True), ("left", False)):
        got = sorted(map(tuple, common.even_join(left, right, "k", how, 10, 100).collect()), key=str)
        assert got == sorted([(k, x, 2 * k if k is not None and k < 900 else None) for k, x in rows if not dropped or k is not None and k < 900], key=str)


def test_similar_documents_with_one_edit(spark):
    """Blocks added, cut off or replaced, at the bound and a little above it: every pair is found."""
    random.seed(11)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    texts = {}
    for i in range(60):
        base = [word() for _ in range(204)]
        n = random.randint(30, 50)
        texts[10 * i] = base
        texts[10 * i + 1] = [base + [word() for _ in range(n)], base[: 204 - n * 4 // 5], base[:80] + [word() for _ in range(n // 3)] + base[80 + n // 3 :]][i % 3]
    want = _groups(texts)
    assert sum(want[k] != k for k in want) == 60 and _similar(spark, texts) == want


def test_similar_documents_of_few_words(spark):
    """Sets of 4 and 5 shingles, similar by just 0.8, and of 3 and 4, which are not."""
    random.seed(12)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    texts = {}
    for i in range(100):
        base = [word() for _ in range(8 if i % 2 else 7)]
        texts[10 * i], texts[10 * i + 1] = base, [*base, word()]
    want = _groups(texts)
    assert sum(want[k] != k for k in want) == 50 and _similar(spark, texts) == want


def test_pages_with_main_text_in_parts(spark):
    """Articles and contents that differ in id or class are all kept, as is a last part in a container of its own."""
    parts = ["<article id='a1'><p>one</p></article><article id='a2'><p>two</p></article>", "<div class='content' id='p1'><p>one one</p></div><div class='content' id='p2'><p>two</p></div>", f"<div class='k1'><p>{'one ' * 40}</p></div><div class='k2'><p>two</p></div>"]
    rows = [(10 * k + i, f"http://h{k}.org/{i}", page(x, SIDE, TAIL)) for k, x in enumerate(parts) for i in range(4)]
    want = {10 * k + i: w for k, w in enumerate(["one two", "one one two", "one " * 40 + "two"]) for i in range(4)}
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want
