"""A corpus pipeline: language, near-duplicates, secrets, mixture and packing, each stage an operator over all rows left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import langid, minhash, mixing, packing, secrets
from quillspark.llm.common import cut, drop_path, new_path, quoted, work
from quillspark.llm.grouping import BROADCAST_IDS

#: SQL can't express learned machines, signatures and tokenizers.
ORACLE_SQL = None


def _own(docs: DataFrame) -> Column:
    """All columns of a row in one, where no name that a stage adds can clash with them."""
    return F.struct(*map(quoted, docs.columns)).alias("own")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; a missing language is filled with the prediction, if any language could be learned.

    Null and empty texts go, and so do those without a letter, however long. Repeated rows and null ids stay; columns of any
    name go through. An empty table gives an empty result.
    """
    model = langid.train(docs.where("lang <> ''"))
    told = langid.identify(docs.where("text RLIKE '\\\\p{L}'").select("doc_id", "text", _own(docs)), model)
    learned = F.when(F.col("lang_pred") != langid.UNKNOWN, F.col("lang_pred"))
    return told.select(F.col("own").withField("lang", F.coalesce("own.lang", learned)).alias("own")).select("own.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows that share an id are documents of their own; of equal ones the first by id and text stays. Rows with a null id stay, and so do
    null or empty texts and texts without words. Columns of any name go through. An empty table gives an empty result.
    """
    rows, ids = docs.where("doc_id IS NOT NULL").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows == ids:
        found = _dropped(docs.select("doc_id", "text"))
        return docs.join(found, "doc_id", "left_anti").select(*map(quoted, docs.columns))
    # Numbers in the order of ids, fixed by the table they are written to.
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text", _own(docs))
    spread = known.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    numbered = cut(spread.select(F.monotonically_increasing_id().alias("row"), "text", "own"), "numbered")
    found = _dropped(numbered.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    return numbered.join(found, "row", "left_anti").select("own.*").unionByName(docs.where("doc_id IS NULL"))


def _dropped(docs: DataFrame) -> DataFrame:
    """Ids of the copies to remove: broadcast after a count, else a shuffled join."""
    found = cut(minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "dropped")
    return F.broadcast(found) if found.count() <= BROADCAST_IDS else found


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked; see ``secrets.redact`` for nulls, repeats and names."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the chance that their source, language and topic are given.

    Null sources and languages are values of their own; null texts and texts without words go. Repeated rows stay or go
    together. Columns of any name go through. An empty table gives an empty result.
    """
    return mixing.weigh(docs.select("doc_id", "text", "lang", "source", _own(docs)), returned=["own"]).where("sampled").select("own.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of 2048 tokens; see ``packing.pack`` for nulls, repeats and long texts."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", by_language),
    ("near_dedup", without_near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's result is written and reread as the next one's documents, and its
    work tables and its predecessor's result are deleted then."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with work(spark) as kept:
            kept.append(path := new_path(spark, name))
            found = stage(spark, docs, sf_dir)
            found.write.option("compression", "zstd").parquet(path)
            docs = spark.read.schema(found.schema).parquet(path)
        if last:
            drop_path(spark, last)
        last = path
    return docs
