"""Ternary outcome to truthfulness summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def summarize(outcomes: DataFrame, key: str = "source") -> DataFrame:
    """``outcomes`` has ``key`` and ``outcome`` in (-1, 0, 1); one row per key with counts and rates."""
    n, right = F.count("*"), F.count_if(F.col("outcome") == 1)
    missed, wrong = F.count_if(F.col("outcome") == 0), F.count_if(F.col("outcome") == -1)
    return outcomes.groupBy(key).agg(
        n.alias("n"), right.alias("n_correct"), missed.alias("n_miss"),
        F.round(right / n, 6).alias("accuracy"), F.round(missed / n, 6).alias("missing"),
        F.round(wrong / n, 6).alias("hallucination"), F.round((2 * right + missed - n) / n, 6).alias("score"),
    )


def labelled_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    outcome = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0)
    return docs.join(labels, "doc_id").withColumn("outcome", outcome)


def truthfulness_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summarize(labelled_outcomes(spark, sf))


QUERIES = {"truthfulness_summary": truthfulness_summary}
ORACLE_SQL = {
    "truthfulness_summary": """
WITH o AS (SELECT source, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS outcome
           FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS n, count(*) FILTER (outcome = 1) AS n_correct, count(*) FILTER (outcome = 0) AS n_miss,
  round(count(*) FILTER (outcome = 1) / count(*), 6) AS accuracy,
  round(count(*) FILTER (outcome = 0) / count(*), 6) AS missing,
  round(count(*) FILTER (outcome = -1) / count(*), 6) AS hallucination,
  round((2 * count(*) FILTER (outcome = 1) + count(*) FILTER (outcome = 0) - count(*)) / count(*), 6) AS score
FROM o GROUP BY source"""
}
