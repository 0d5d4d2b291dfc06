"""Queries of the corpus operators: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, katz, license_scan, packing, quality, simhash, token_count, url_filter, warc
from .common import shared_dir

#: The vocabulary that op3 counts with.
VOCABULARY = "byte_bpe_50k.json"


#: The conversation that op10 adds: control strings as what both say.
PROBE = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_texts(spark), digests=license_scan.known_digests(spark))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = katz.score_corpus(table(spark, sf_dir, "documents"))
    return scored


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = warc.write_archives(table(spark, sf_dir, "pages"), warc.new_folder(shared_dir(spark)))
    found = warc.capture_table(spark, place, with_block=False)
    kind = F.col("response.kind")
    return found.select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), kind.alias("record_type"), F.col("refers_to_page").alias("refers_to")
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(probe)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_katz": op4_katz,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_url_filter": op9_url_filter,
    "op10_chat": op10_chat,
}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": decontaminate.oracle_sql(), "op2_license_scan": license_scan.oracle_sql(), "op8_warc": warc.oracle_sql(), "op10_chat": chat.oracle_sql(PROBE)}
