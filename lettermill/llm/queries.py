"""One query opN_<name> for each corpus operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lettermill.llm import bktree, centroids, licenses, maxscore, packing, periodic, pieces, sharding, simhash, suffix, token_counts, toxicity, url_filter
from lettermill.llm.common import table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_likeness(table(spark, sf_dir, "documents"), radius=3)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"), span=100)


def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules, default="allow")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bktree.near_dedup(table(spark, sf_dir, "documents"), width=3, radius=3)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.summary(periodic.collapse(table(spark, sf_dir, "documents"), edit=periodic.repeat_tail))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), shards=40)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_fingerprints, op2_suffix_dedup, op3_maxscore_top_k, op4_license_scan, op5_best_fit_packing, op6_toxicity, op7_url_filter, op8_sentencepiece, op9_token_counts, op10_simhash_near_dedup, op11_periodic_runs, op12_centroid_clustering, op13_sharding)
}
ORACLE_SQL: dict[str, str] = {
    "op3_maxscore_top_k": maxscore.oracle_sql(),
    "op4_license_scan": licenses.oracle_sql(),
    "op7_url_filter": url_filter.oracle_sql(),
    "op12_centroid_clustering": centroids.oracle_sql(),
}
