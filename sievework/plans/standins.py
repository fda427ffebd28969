"""Stand-ins for question-answering and rollout data, derived from the driver tables, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """A response per document in one of six shapes, with goldens, an out-of-knowledge flag and judge verdicts."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text", F.get(F.split("text", " "), F.lit(0)).alias("w1"), F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit("none")).alias("w2"))
    kind, w1, w2 = F.col("doc_id") % 6, F.col("w1"), F.col("w2")
    response = (
        F.when(kind == 0, F.concat(F.lit("no box here "), w1)).when(kind == 1, F.lit("\\boxed{I don't know}")).when(kind == 2, F.lit("\\boxed{invalid question}"))
        .when(kind == 3, F.concat(F.lit("so \\boxed{ The "), w1, F.lit("! }"))).when(kind == 4, F.concat(F.lit("\\boxed{"), w2, F.lit("} then \\boxed{"), w1, F.lit("}")))
        .otherwise(F.concat(F.lit("<answer> "), w1, F.lit(" </answer>")))
    )
    judge = F.array(F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0), F.when(F.col("doc_id") % 5 == 0, -1).otherwise(0))
    return docs.select("doc_id", "source", response.alias("response"), F.array("w1", F.lit("other")).alias("target"), (F.col("doc_id") % 7 == 0).alias("ook"), judge.alias("judge"))


RESPONSES = r"""d AS (SELECT doc_id, source, string_split(text, ' ')[1] AS w1, coalesce(string_split(text, ' ')[2], 'none') AS w2 FROM documents),
r AS (SELECT doc_id, source, CASE doc_id % 6 WHEN 0 THEN 'no box here ' || w1 WHEN 1 THEN '\boxed{I don''t know}' WHEN 2 THEN '\boxed{invalid question}'
  WHEN 3 THEN 'so \boxed{ The ' || w1 || '! }' WHEN 4 THEN '\boxed{' || w2 || '} then \boxed{' || w1 || '}' ELSE '<answer> ' || w1 || ' </answer>' END AS response,
  [w1, 'other'] AS target, doc_id % 7 = 0 AS ook, [CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE 0 END] AS judge FROM d),
p AS (SELECT *, CASE WHEN regexp_matches(response, '\\boxed\{[^}]*\}') THEN trim(regexp_extract(response, '\\boxed\{([^}]*)\}', 1))
  WHEN contains(response, '<answer>') THEN trim(regexp_extract(response, '(?s)<answer>(.*?)</answer>', 1)) END AS answer FROM r)"""


def sql_normal(x: str) -> str:
    return (
        f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), "
        "lambda t: t NOT IN ('a', 'an', 'the', '')), ' ')"
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """A sample per labelled document: uid is its source, the score -1, 0 or 1, the length its words."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("uid"), F.size(F.split("text", " ")).alias("len"))
    score = F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 1, 1.0).otherwise(0.0)
    return docs.join(table(spark, sf, "labels"), "doc_id").select("doc_id", "uid", "len", score.alias("score"))


SCORED = """s AS (SELECT doc_id, source AS uid, len(string_split(text, ' '))::INT AS len,
  CASE WHEN toxic = 1 THEN -1.0 WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM documents JOIN labels USING (doc_id))"""


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A row per token: uid is an event's user, t its place in time, with reward, value, two log-probabilities, mask."""
    from pyspark.sql import Window

    ev = table(spark, sf, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select(
        F.col("user_id").alias("uid"), t.alias("t"), (F.col("value") / 97.0).alias("reward"), (k / 100.0).alias("value"), (-(F.col("value") % 7) / 5.0 - 0.1).alias("old_logp"),
        (-(k % 9) / 6.0 - 0.1).alias("ref_logp"), F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(1.0).alias("mask"), "event_id", "event_type",
    )


TOKENS = """k AS (SELECT user_id AS uid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value / 97.0 AS reward,
  (props->>'$.k')::DOUBLE / 100.0 AS value, -(value % 7) / 5.0 - 0.1 AS old_logp, -((props->>'$.k')::DOUBLE % 9) / 6.0 - 0.1 AS ref_logp,
  CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS mask, event_id, event_type FROM events)"""


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """``tokens`` as arrays, a row per uid."""
    rows = tokens(spark, sf).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("t", "reward", "value", "old_logp", "ref_logp", "mask"))).alias("x"))
    pick = lambda c: F.transform("x", lambda e: e[c]).alias(c)
    return rows.select("uid", *map(pick, ("t", "reward", "value", "old_logp", "ref_logp", "mask")))
