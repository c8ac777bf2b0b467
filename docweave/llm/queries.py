"""The registered queries of the ten operators: each applies one with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, hpylm, runtime, secrets, vafile, warc
from .mixing import mixture
from .ngram_join import ngram_join
from .pii import personal_data
from .toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs on one ledger: English documents by the base rules, then all documents by all rules, of which the first has seen some."""
    documents = _table(spark, sf_dir, "documents")
    _, ledger = secrets.scan(documents.where("lang = 'en'"), None, tuple(r for r in secrets.RULES if r.base))
    findings, _ = secrets.scan(documents, ledger)
    return secrets.digest(findings)


ORACLES["op7_secret_ledger"] = secrets.oracle_sql()


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


@query
def op3_domain_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), runtime.new_folder(spark, "warc"))


ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
b AS (SELECT i, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', i + 1, 1) AS c FROM range(32) t(i)),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS x FROM p),
g AS (SELECT page_id, n, x, unnest(range(32)) AS k FROM h),
v AS (SELECT page_id, n, x, k, (('0x' || substr(x, 1 + 10 * (k // 8)::INTEGER, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31 AS i FROM g),
d AS (SELECT page_id, n, x, string_agg(c, '' ORDER BY k) AS digest FROM v JOIN b USING (i) GROUP BY page_id, n, x),
f AS (SELECT x, min(page_id) AS first FROM h GROUP BY x)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (x)"""


@query
def op2_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(_table(spark, sf_dir, "embeddings"))


ORACLES["op2_vector_approximation"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


@query
def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.language_model(_table(spark, sf_dir, "documents"))
