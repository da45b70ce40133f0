"""One query for each operator of the subpackage, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import compaction, crosstoken, embdedup, hmm_lm, langid, linededup, minhash, mixing, packing, periodic, secrets, topk, weaklabel
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_documents(table(spark, sf_dir, "documents"))


def op2_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.sharded(table(spark, sf_dir, "documents"), new_path(spark, "shards"))


def op3_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabel.score_quality(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(table(spark, sf_dir, "documents"), returned=["doc_id", "source", "lang"])


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_history(table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS long) AS doc_id", "text"), "doc_id"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(periodic.with_planted_runs(table(spark, sf_dir, "documents"))))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(linededup.without_common_lines(table(spark, sf_dir, "documents")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.digest(crosstoken.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {
    "op1_hmm_lm": op1_hmm_lm,
    "op2_compaction": op2_compaction,
    "op3_weak_label_quality": op3_weak_label_quality,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_exact_topk": op7_exact_topk,
    "op8_secret_scan": op8_secret_scan,
    "op9_packing": op9_packing,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_line_dedup": op12_line_dedup,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL = {
    "op4_minhash_near_dedup": minhash.NEAR_SQL,
    "op8_secret_scan": secrets.SCAN_SQL,
    "op7_exact_topk": topk.SEARCH_SQL,
    "op10_embedding_near_dedup": embdedup.NEAR_SQL,
    "op12_line_dedup": linededup.LINES_SQL,
}
