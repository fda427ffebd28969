"""Queries: final answers, placed rewards, files and dispatch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import final_answer as A
from sievework.operators import losses as L
from sievework.operators.batch import chunks, with_row_id
from sievework.operators.filters import resume
from sievework.plans.standins import SCORED, TOKENS, scored, table, tokens
from sievework.sources import io

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share; only in local mode, where all are one process, a temporary one does."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base}/sievework-{uuid.uuid4().hex}"


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id || '000' WHEN 1 THEN 'frac{1}{2}' ELSE 'x' END AS pred, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS score FROM documents")
def x18_r12_final_answers(spark: SparkSession, sf: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat("doc_id", F.lit(",000 dollars"))).when(F.col("doc_id") % 3 == 1, F.lit("y = frac12")).otherwise(F.lit("$\\text{x}$ km"))
    s = A.minerva_score(F.concat(F.lit("so\nAnswer: "), tail), F.concat("doc_id", F.lit("000")))
    return table(spark, sf, "documents").select("doc_id", s["pred"].alias("pred"), s["score"].alias("score"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS strict, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE -0.9 END::DOUBLE AS tool, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS math, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.1 END::DOUBLE AS shaped FROM documents")
def x20_v6_r11_r13_boxed_scores(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit("<think>a</think> \\boxed{"), F.when(F.col("doc_id") % 2 == 0, F.lit("1/2")).otherwise(F.lit("3")), F.lit("}"))
    truth = F.lit("1/2")
    return table(spark, sf, "documents").select("doc_id", A.strict_box_score(reply, truth)["score"].alias("strict"), A.tool_use_score(reply, truth, F.lit(4))["score"].alias("tool"), A.math_score(reply, truth).alias("math"), A.boxed_format_score(reply, truth).alias("shaped"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS fenced, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS counted, CASE WHEN doc_id % 5 = 0 THEN 0.5 WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS judged, true AS same FROM documents")
def r25_r32_r33_x25_reply_scores(spark: SparkSession, sf: str) -> DataFrame:
    language = F.when(F.col("doc_id") % 2 == 0, F.lit("python")).otherwise(F.lit("cpp"))
    code = F.lit("<think>\na\n</think>\n<answer>\n```python\nx\n```\n</answer>")
    box = F.concat(F.lit("\\boxed{"), F.when(F.col("doc_id") % 3 == 0, F.lit("True")).otherwise(F.lit("no")), F.lit("}"))
    split = F.when(F.col("doc_id") % 5 == 0, F.lit("test")).otherwise(F.lit("train"))
    return table(spark, sf, "documents").select("doc_id", A.code_format(code, language).alias("fenced"), A.char_count_score(box, F.lit("True")).alias("counted"), A.judged_score(split, F.lit(0.5), box).alias("judged"), A.outputs_equal(F.lit(" a \n b\n"), F.lit("a\nb")).alias("same"))


@query(f"WITH {SCORED} SELECT doc_id, len AS n, score AS last, score AS total FROM s")
def r28_r30_placed_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """The score at the last response token; a scorer that failed counts as 0."""
    rows = scored(spark, sf).withColumn("tokens", A.score_at_last_token(F.col("len"), F.coalesce("score", F.lit(0.0))))
    return rows.select("doc_id", F.size("tokens").alias("n"), F.element_at("tokens", -1).alias("last"), F.aggregate("tokens", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"""WITH {TOKENS}, c AS (SELECT *, (reward - avg(reward) OVER ()) * (ref_logp - avg(ref_logp) OVER ()) AS cov FROM k)
SELECT event_id, round(CASE WHEN cov > 0.01 AND cov < 0.2 THEN 0 ELSE -reward * exp(ref_logp - old_logp) END, 6) AS loss FROM c""")
def t6_clip_cov_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Every token whose covariance lies in the band loses its loss."""
    rows = L.clip_cov_loss(tokens(spark, sf), "old_logp", "ref_logp", "reward", 0.01, 0.2, 1.0, 1, "event_id")
    return rows.select("event_id", F.round("loss", 6).alias("loss"))


@query(f"WITH {TOKENS} SELECT round(avg(old_logp), 6) AS policy_logps, round(avg(ref_logp), 6) AS reference_logps FROM k WHERE mask = 1")
def v2_v3_optional_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Means of optional columns; those that aren't there are left out."""
    rows = tokens(spark, sf).where("mask = 1").withColumnsRenamed({"old_logp": "policy_logps", "ref_logp": "reference_logps"})
    return rows.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("policy_logps", "reference_logps", "policy_logits") if c in rows.columns))


@query("SELECT (n_nationkey // 5)::BIGINT AS worker, count(*) AS rows, sum(n_nationkey)::BIGINT AS keys FROM nation GROUP BY 1")
def v18_v20_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Equal chunks to workers and their results together again."""
    parts = chunks(with_row_id(table(spark, sf, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("bigint")), "n_nationkey"), 5)
    return parts.groupBy(F.col("chunk").alias("worker")).agg(F.count("*").alias("rows"), F.sum("n_nationkey").alias("keys"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count({c}) AS filled FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def v19_schema_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and filled values of each column."""
    docs = table(spark, sf, "documents")
    counts = docs.agg(F.count("*").alias("rows"), *(F.count(c).alias(c) for c in docs.columns))
    return counts.select("rows", F.explode(F.create_map(*(x for c in docs.columns for x in (F.lit(c), F.col(c))))).alias("name", "filled"))


@query("SELECT doc_id, source FROM documents UNION ALL SELECT doc_id, source FROM documents")
def s1_u1_parquet_files(spark: SparkSession, sf: str) -> DataFrame:
    return io.parquet(spark, f"{sf}/documents.parquet", f"{sf}/documents.parquet").select("doc_id", "source")


@query("SELECT doc_id, source AS prompt, lang AS response FROM documents")
def s2_nested_keys(spark: SparkSession, sf: str) -> DataFrame:
    nested = table(spark, sf, "documents").select("doc_id", F.struct(F.struct(F.col("source").alias("q")).alias("a"), F.col("lang").alias("b")).alias("extra"))
    return io.prompts_and_responses(nested, ["extra", "a", "q"], ["extra", "b"], keep=("doc_id",))


@query("SELECT source AS prompt, text AS chosen, lang AS rejected FROM documents")
def s3_preference_rows(spark: SparkSession, sf: str) -> DataFrame:
    return io.preference(table(spark, sf, "documents").select(F.col("source").alias("prompt"), F.col("text").alias("chosen"), F.col("lang").alias("rejected"), "n_chars"))


@query("SELECT conv_id, string_agg(coalesce(role, '-') || ':' || coalesce(text, '-'), '|' ORDER BY turn, role, text) AS turns, NULL::VARCHAR AS tools FROM conversations GROUP BY conv_id")
def s4_conversation_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    read = io.conversations(rows.withColumn("messages", F.struct("conv_id", "messages")))
    told = F.transform("messages.messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("-")), F.lit(":"), F.coalesce(m["text"], F.lit("-"))))
    return read.select(F.col("messages.conv_id").alias("conv_id"), F.array_join(told, "|").alias("turns"), "tools")


@query("SELECT doc_id, source, text FROM documents")
def s5_s6_s13_jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark)
    table(spark, sf, "documents").select("doc_id", "source", "text").write.json(out)
    return io.jsonl(spark, out, "doc_id long, source string, text string")


@query("SELECT o_orderkey, o_orderkey % 3 AS step, o_orderkey % 3 AS extra FROM orders")
def s9_s14_step_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """A folder per step; a step that is written again replaces itself."""
    out, rows = scratch(spark), table(spark, sf, "orders").select("o_orderkey")
    for step in (0, 1, 2, 1):
        io.write_step(rows.where(F.col("o_orderkey") % 3 == step), out, step, {"extra": F.lit(step).cast("bigint")})
    return spark.read.schema("o_orderkey long, extra long, step long").json(out).select("o_orderkey", "step", "extra")


@query("SELECT doc_id, source FROM documents")
def s16_s18_resumed_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of an appending writer, the second with what the first left out."""
    out, docs = scratch(spark), table(spark, sf, "documents").select("doc_id", "source")
    for part in (docs.where("doc_id % 2 = 0"), docs):
        try:
            done = spark.read.parquet(out).select(F.md5(F.col("doc_id").cast("string")).alias("h"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = part.limit(0).select(F.lit("").alias("h"))
        resume(part, "doc_id", done, "h").write.mode("append").parquet(out)
    return spark.read.parquet(out)
