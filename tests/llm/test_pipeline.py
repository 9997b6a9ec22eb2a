"""SentencePiece against its own library, and the corpus pipeline against brute force."""

import gc
import struct
import time

import pytest
import sentencepiece as reference
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import sentencepiece, simhash, toxicity
from weftgraph.llm.queries import QUERIES, tokenizer_path
from weftgraph.operators import storage

TEXTS = [None, "", " ", "  a  b ", "<s> </s> <unk> <0x0A>", "▁x ▁", "日本語テスト🙂\x00\n\t", "a" * 5000, " " * 40, "▁▁ ▁", "line\nline\r\n", "word " * 20_000, "same", "same", "�​   x"]


@pytest.fixture(scope="module")
def model():
    with open(tokenizer_path(), "rb") as f:
        return f.read()


def test_parity(spark, sf, model):
    own = reference.SentencePieceProcessor(model_proto=model)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = sentencepiece.encode(df, model)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert r.parity and r.ids == own.encode(t or "") and r.n_tokens == len(r.ids) and r.decoded == own.decode(r.ids)
    back = {r.doc_id: r.text for r in sentencepiece.decode(out, model).collect()}
    assert back == {i: r.decoded for i, r in got.items()}
    assert sum(back[i] != (t or "") for i, t in rows) <= 2  # the marker itself reads back as a space
    assert sentencepiece.encode(df.limit(0), model).count() == 0


def test_codec_keeps_what_recurs():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    small, large = sentencepiece.Codec(model, cached=40), sentencepiece.Codec(model)
    for i in range(12):
        texts = ["the same words come again", " ".join(f"w{i}x{k}" for k in range(30)), "", "  two   spaces "]
        a, b = small.encode(texts), large.encode(texts)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() and a[2] == b[2] == [True] * 4
        assert small.decode(*a[:2]) == texts
        assert "▁again" in small.known and len(small.known) <= 40 + 50
    assert len(large.known) > 300


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def unigram(squeeze=0):
    """A unigram model of a few pieces, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -2.0), ("a", -3.1), ("b", -3.3), ("▁a", -2.7), ("ab", -4.05), ("▁ab", -4.2), ("abb", -6.5), ("▁▁", -3.9))]
    out = b"".join(_field(1, _field(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _field(3, k)) for p, s, k in pieces)
    return out + _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, squeeze) + _field(5, 1))


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram(squeeze):
    proto = unigram(squeeze)
    codec, own = sentencepiece.Codec(proto), reference.SentencePieceProcessor(model_proto=proto)
    texts = ["ab", "abb ab a", "  a   b ", "xab\nbb", "é", "aabbab" * 50]
    ids, ends, same = codec.encode(texts)
    assert all(same) and [ids[i:j].tolist() for i, j in zip(ends, ends[1:])] == own.encode(texts)
    assert codec.decode(ids, ends) == [own.decode(x) for x in own.encode(texts)]
    whole = codec.whole.encode_batch_fast(texts, add_special_tokens=False)
    assert [e.ids for e in whole] == own.encode(texts)


def test_not_models():
    for bad in (b"", b"junk", unigram()[:-3], _field(1, _field(1, b"a"))):
        with pytest.raises((ValueError, IndexError)):
            sentencepiece.parse_model(bad)


def test_stages(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic, near, mix, tokens = [f for _, f in corpus_pipeline.STAGES]
    first = corpus_pipeline.saved(toxic(spark, docs, sf), "a")
    labels = toxicity.learnable(spark.read.parquet(f"{sf}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels)).where("predicted = 1").collect()}
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in docs.collect()} - rejected
    second = corpus_pipeline.saved(near(spark, first, sf), "b")
    classes = {r.doc_id: r.component_id for r in simhash.similar_documents(first).collect()}
    kept = [r.doc_id for r in second.collect()]
    assert sorted(kept) == sorted(set(classes.values()))
    texts = [r.text for r in second.collect()]
    assert len(set(texts)) == len(texts)  # no exact copy is left
    third = corpus_pipeline.saved(mix(spark, second, sf), "c")
    assert first.schema == second.schema == third.schema == docs.schema
    assert {r.doc_id for r in third.collect()} <= set(kept) and third.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    last = tokens(spark, third, sf)
    assert last.count() == third.count() and last.where("not parity").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == last.count()


def test_tables_relieve_the_driver(spark, monkeypatch):
    assert "rim native heap" in storage.trim_jvm(spark)
    monkeypatch.setattr(storage, "HEAP", 0)
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    for due, falls in ((0, True), (time.monotonic() + 600, False)):
        monkeypatch.setattr(storage, "_due", due)
        spark._jvm.java.lang.System.gc()
        least = used()
        for _ in range(8):
            spark._jvm.java.nio.ByteBuffer.allocate(16 << 20)
        gc.collect()  # py4j lets go of them
        assert used() > least + 100
        storage.saved(spark.range(3), "small")
        assert (used() < least + 60) == falls


def test_executors_collect_garbage(spark, monkeypatch):
    """Tasks do it, so that each executor's JVM does; here that is the driver's own, and a table that is saved leaves it out."""
    beans = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    was = beans()
    storage.collect_garbage(spark)
    assert beans() >= was + 1
    calls = []
    monkeypatch.setattr(storage, "collect_garbage", lambda s: calls.append(s))
    for local in (True, False):
        monkeypatch.setattr(storage, "_due", 0)
        if not local:
            monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
        storage.relieve(spark)
        assert len(calls) == (0 if local else 1)


def test_stages_on_empty_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0, name


def test_every_operator_is_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
