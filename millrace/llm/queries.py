"""The queries ``opN_<name>``: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmlcrf, licences, media, mixing, packing, sharding, simhash, toxicity, warc, winnowing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def licence_rows(docs: DataFrame) -> DataFrame:
    files = docs.select("doc_id", licences.document_path(F.col("doc_id"), F.col("source")).alias("path"), "text")
    return licences.scan(files).select("doc_id", "path", "licence", "licence_score", "found_in", "inherited")


def op2_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_rows(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_marks(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "tokens", "cell_source", "cell_lang", "cell_topic", "probability", "sampled")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(_table(spark, sf_dir, "documents"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return placed.select("doc_id", sharding.slot(F.col("doc_id")).alias("slot"), "shard", size.alias("n_bytes"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extract(_table(spark, sf_dir, "pages"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_simhash_near_dedup, op2_licence_scans, op3_mixing, op4_winnowing, op5_warc_round_trip, op6_media_columns, op7_toxicity, op8_sharding, op9_html_extraction, op10_best_fit_packing)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op2_licence_scans": licences.sql(), "op3_mixing": mixing.sql(), "op8_sharding": sharding.sql()}
