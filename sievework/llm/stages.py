"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and applies one operator to all of ``docs``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bpe, minhash, mixing, pii, quality_rules
from sievework.llm.shared import cut

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Ids up to which the list of dropped documents is broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that many documents of a source share."""
    return quality_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more), the one of least
    doc_id; of rows that repeat a doc_id one of each text stays."""
    groups = minhash.near_duplicates(docs, n=5, percent=80)
    dropped = cut(groups.where("NOT kept").select("doc_id").distinct())
    repeated = cut(groups.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    left = docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return left
    again = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document of the mix."""
    coded = bpe.encode_decode(docs, TOKENIZER)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
