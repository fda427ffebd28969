"""A training corpus from ``documents``: quality rules, near-duplicate removal, masking of personal data, mixing of
sources and encoding, each stage written as Parquet and read again as the next one's documents.

Defined cases: a null, blank or short text fails the quality rules and goes; rows that repeat a doc_id are judged one by
one, and of those with equal texts one stays after near_dedup; a null doc_id is kept as it is, linked with nothing; null
sources, langs and sizes are values like others; an empty table gives no rows; extra columns are carried up to the last
stage, which returns doc_id, n_tokens and ids; a document that the mix takes several times has as many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import stages
from sievework.llm.shared import fresh_dir

STAGES = [
    ("quality", stages.quality),
    ("near_dedup", stages.near_dedup),
    ("pii", stages.mask_pii),
    ("mixing", stages.mix),
    ("bpe", stages.encode),
]

#: Near-duplicate groups, keys drawn from hashes and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
