"""From documents to token ids: STAGES in their order, each working on what the one before has kept.

A stage gets (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

1. toxicity: documents that score 0.3 or more go.
2. near_duplicates: of each class of texts that share 0.8 of their five-word runs, the least doc_id stays.
3. secrets: every found secret is replaced by a mark; documents stay.
4. mixture: documents of languages short of their target are repeated as their fitted rate says; none goes.
5. tokens: byte-level BPE ids of every text.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docweave.llm import bpe, runtime
from docweave.llm import mixing, secrets, toxicity
from docweave.llm import ngram_join as near

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Working tables of the latest stage: its result is written when the next one starts, and they can go.
_WORKING: list[str] = []


def _stage(f):
    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _WORKING:
            runtime.remove(spark, _WORKING.pop())
        before = set(runtime.made())
        out = f(spark, docs, sf_dir)
        _WORKING.extend(p for p in runtime.made() if p not in before)
        return out

    return run_stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, _labels(spark, sf_dir)))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduplicate(docs)


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


@_stage
def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remix(docs, _labels(spark, sf_dir))


@_stage
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_languages),
    ("tokens", encode_tokens),
]
#: The learned stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(STAGES):
        path = runtime.new_folder(spark, f"stage{k}-{name}")
        f(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
