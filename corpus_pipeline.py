"""A training corpus from `documents`: toxic texts go, near copies go, sources are mixed, texts become tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import mixing, sentencepiece, simhash, toxicity
from weftgraph.llm.common import read, saved
from weftgraph.llm.queries import tokenizer_path
from weftgraph.operators.storage import relieve


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 1/2 or more go. Fitted on the labels outside the held-out fold."""
    return toxicity.reject(docs, toxicity.fit(docs, toxicity.learnable(read(spark, sf_dir, "labels"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by five words and a similarity of 0.8 or more, by SimHash and what it can't span by an exact filter, the one with the smallest doc_id stays."""
    return simhash.keep_representatives(docs, simhash.similar_documents(docs, words=5, similarity=0.8))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times, in training order."""
    return mixing.training_order(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each row, which read back give its text."""
    relieve(spark)
    return sentencepiece.encode(docs, sentencepiece.load(spark, tokenizer_path())).select("doc_id", "ids", "n_tokens", "parity")


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("sentencepiece", tokenize)]

#: SQL can express neither models, fingerprints nor tokenizers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
