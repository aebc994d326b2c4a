"""The registered queries of the corpus operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, code_lloyd, fingerprints, hard_negatives, license_scan, media_jpeg, mixing, packing, quality, sharding, simhash, token_counts, toxicity
from .common import table


def _tokenizer(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_jpeg.read_media(media_jpeg.store_media(table(spark, sf_dir, "documents")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), *_tokenizer("byte_bpe_50k.tiktoken"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), *_tokenizer("byte_bpe_50k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    again = F.round(F.get("positions", F.lit(1)), 9).alias("position_again")
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", F.round("position", 9).alias("position"), again)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *_tokenizer("byte_bpe_50k.json"))


def op12_code_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_lloyd.compress(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings"), seventh=F.col("vec_id") % 7 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_license_scan, op3_byte_bpe, op4_token_counts, op5_fingerprints, op6_mixing, op7_quality, op8_sharding, op9_simhash, op10_toxicity,
        op11_packing, op12_code_lloyd, op13_hard_negatives,
    )
}

#: The other operators are beyond SQL; tests hold their queries against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.SQL, "op12_code_lloyd": code_lloyd.SQL, "op13_hard_negatives": hard_negatives.SQL}
