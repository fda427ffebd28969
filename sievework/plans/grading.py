"""Queries: matched and plain answers, whole-batch rewards, encoded pairs, evaluation summaries, dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import matching as M
from sievework.operators import batch, metrics, pairs, rewards
from sievework.plans.extras import scratch
from sievework.plans.standins import SCORED, scored, table
from sievework.sources import io

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


SPACE = "' ' || chr(9) || chr(10) || chr(13)"


def _cuts(marks: list[tuple[str, bool]], source: str, stem: str, counts: bool) -> tuple[str, str]:
    """A CTE per mark over (doc_id, hit, x), and the name of the last one."""
    out, last = [], source
    for i, (mark, after) in enumerate(marks):
        m = "'" + mark.replace("\n", "' || chr(10) || '") + "'"
        rest = "right(x, p - 1)" if after else f"left(x, len(x) - p + 1 - len({m}))"
        out.append(f"{stem}{i} AS (SELECT doc_id, hit OR ({str(counts).lower()} AND p > 0) AS hit, CASE WHEN p > 0 THEN trim({rest}, {SPACE}) ELSE x END AS x FROM (SELECT *, strpos(reverse(lower(x)), reverse({m})) AS p FROM {last}))")
        last = f"{stem}{i}"
    return ", ".join(out), last


_lead, _led = _cuts([*((m, True) for m in M.LEADS), *((m, False) for m in M.TRAILS)], "r", "a", True)
_stop, _stopped = _cuts([(". ", False)], "b", "c", False)
_verb, _done = _cuts([(m, True) for m in M.VERBS], _stopped, "d", True)


@query(rf"""WITH r AS (SELECT doc_id, false AS hit, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || ' Answer: x = ' || doc_id || '. Done' WHEN 2 THEN text || ' so \boxed{{' || doc_id || '}} is the answer'
  ELSE text || ' we get {{\fbox{{ ' || n_chars || '}}}}. Done' END AS x FROM documents), {_lead},
b AS (SELECT doc_id, hit OR coalesce(box, '') <> '' AS hit, CASE WHEN coalesce(box, '') <> '' THEN box ELSE x END AS x
  FROM (SELECT *, CASE WHEN contains(x, '\boxed') OR contains(x, '\fbox') THEN trim(regexp_extract(x, '\\(?:boxed|fbox)\{{([^{{}}]*)\}}[^\\]*$', 1)) END AS box FROM {_led})), {_stop}, {_verb}
SELECT doc_id, hit AND regexp_matches(x, '[0-9]') AS matched, x AS answer FROM {_done}""")
def x22_matched_answer(spark: SparkSession, sf: str) -> DataFrame:
    kind, text = F.col("doc_id") % 4, F.col("text")
    reply = (
        F.when(kind == 0, text).when(kind == 1, F.concat(text, F.lit(" Answer: x = "), "doc_id", F.lit(". Done"))).when(kind == 2, F.concat(text, F.lit(" so \\boxed{"), "doc_id", F.lit("} is the answer")))
        .otherwise(F.concat(text, F.lit(" we get {\\fbox{ "), "n_chars", F.lit("}}. Done")))
    )
    return table(spark, sf, "documents").select("doc_id", M.matched_answer(reply).alias("m")).select("doc_id", "m.matched", "m.answer")


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN o_custkey::VARCHAR WHEN 2 THEN o_custkey || ' *10^6' WHEN 3 THEN o_custkey || '+3/4'
  WHEN 4 THEN o_custkey::VARCHAR WHEN 5 THEN '-' || o_custkey || '/sqrt(2)' WHEN 6 THEN o_custkey || ' , ' || o_orderkey ELSE (o_custkey * 1000 + 123)::VARCHAR END AS answer FROM orders""")
def x24_plain_answer(spark: SparkSession, sf: str) -> DataFrame:
    n, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 8
    given = (
        F.when(kind == 0, F.concat(F.lit("\\text{"), "o_orderpriority", F.lit("}"))).when(kind == 1, F.concat(F.lit("$"), n, F.lit(".0$"))).when(kind == 2, F.concat(n, F.lit(" million")))
        .when(kind == 3, F.concat(n, F.lit("\\tfrac{3}{4}"))).when(kind == 4, F.concat(n, F.lit(" cm^2 "))).when(kind == 5, F.concat(F.lit("-  \\frac{"), n, F.lit("}{\\sqrt{2}}")))
        .when(kind == 6, F.concat(n, F.lit(" and "), F.col("o_orderkey").cast("string"))).otherwise(F.concat(n, F.lit(",123\\%")))
    )
    plain = M.plain_answer(given)
    return table(spark, sf, "orders").select("o_orderkey", plain.alias("answer"))


@query(f"WITH {SCORED} SELECT doc_id, len AS n, score AS acc, score AS last, len + 0 AS words FROM s")
def r31_batch_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer of whole batches that gives a score and a further field."""
    made = rewards.batch_rewards(scored(spark, sf), "len", lambda df: F.struct(df["score"].alias("score"), df["len"].alias("words")), ["words"])
    return made.select("doc_id", F.size("rewards").alias("n"), "acc", F.element_at("rewards", -1).alias("last"), "words")


@query("""WITH t AS (SELECT c_custkey, [c_nationkey + 1, 2] AS p, [c_custkey, c_custkey + 1, 3] AS a, [c_custkey + 7] AS b FROM customer),
w AS (SELECT c_custkey, list_concat(list_concat(p, a), [9]) AS a, list_concat(list_concat(p, b), [9]) AS b FROM t)
SELECT c_custkey, array_to_string(list_concat(a, [0, 0, 0, 0, 0])[1:5], ' ') AS chosen, array_to_string(list_concat(b, [0, 0, 0, 0, 0])[1:5], ' ') AS rejected,
  5::BIGINT AS chosen_mask, 4::BIGINT AS rejected_mask FROM w""")
def y7_encoded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of which the chosen one is cut and the rejected one filled."""
    key = F.col("c_custkey").cast("bigint")
    two = F.array(F.col("c_nationkey").cast("bigint") + 1, F.lit(2).cast("bigint"))
    pair = pairs.encoded_pair(two, F.array(key, key + 1, F.lit(3).cast("bigint")), F.array(key + 7), 5, 9)
    rows = table(spark, sf, "customer").select("c_custkey", pair.alias("p"))
    total = lambda i: F.aggregate(F.col("p.attention_mask")[i], F.lit(0).cast("bigint"), lambda s, x: s + x)
    shown = lambda i: F.array_join(F.col("p.input_ids")[i].cast("array<string>"), " ")
    return rows.select("c_custkey", shown(0).alias("chosen"), shown(1).alias("rejected"), total(0).alias("chosen_mask"), total(1).alias("rejected_mask"))


EVALUATED = f"""e AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' AND l_quantity > 25 THEN 0 ELSE -1 END AS score,
  CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount > 0.05 THEN '{metrics.EXACT}' ELSE 'judged' END WHEN l_returnflag = 'A' AND l_quantity > 25 THEN '{metrics.MISSING}'
    WHEN l_tax > 0.04 THEN '{metrics.UNBOXED}' ELSE 'judged' END AS explanation FROM lineitem),
g AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, explanation) = 1),
n AS (SELECT count(*) AS total, count(*) FILTER (score = 1) AS n_correct, count(*) FILTER (explanation = '{metrics.MISSING}') AS n_miss,
  count(*) FILTER (explanation = '{metrics.UNBOXED}') AS n_no_boxed, count(*) FILTER (explanation = '{metrics.EXACT}') AS n_exact_match FROM g)"""


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts at questions: an order is a question, a line an attempt."""
    right, missed = F.col("l_returnflag") == "R", (F.col("l_returnflag") == "A") & (F.col("l_quantity") > 25)
    why = (
        F.when(right, F.when(F.col("l_discount") > 0.05, F.lit(metrics.EXACT)).otherwise("judged")).when(missed, F.lit(metrics.MISSING))
        .when(F.col("l_tax") > 0.04, F.lit(metrics.UNBOXED)).otherwise("judged")
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(right, 1).when(missed, 0).otherwise(-1).alias("score"), why.alias("explanation"))


@query(f"""WITH {EVALUATED} SELECT *, total - n_correct - n_miss AS n_hallucination, total - n_correct - n_miss - n_no_boxed AS n_hallucination_boxed, (2 * n_correct + n_miss - total) / total AS score,
  n_correct / total AS accuracy, n_miss / total AS missing, n_exact_match / total AS em, n_no_boxed / total AS no_boxed, (total - n_correct - n_miss) / total AS hallucination,
  (total - n_correct - n_miss - n_no_boxed) / total AS hallucination_boxed FROM n""")
def a1_evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.evaluation_summary(evaluated(spark, sf), "l_orderkey", "l_linenumber")


@query(f"WITH {EVALUATED} SELECT l_orderkey, l_linenumber, e.score, explanation, (n_correct / total)::DOUBLE AS accuracy FROM e, n")
def s15_evaluation_files(spark: SparkSession, sf: str) -> DataFrame:
    """Summary and judged attempts, written as JSON and read again."""
    out, rows = scratch(spark), evaluated(spark, sf)
    io.write_evaluation(metrics.evaluation_summary(rows, "l_orderkey", "l_linenumber"), rows, out)
    read = io.jsonl(spark, f"{out}/results", rows.schema)
    summary = io.jsonl(spark, f"{out}/metrics", "metrics struct<accuracy: double>").select("metrics.accuracy")
    return read.crossJoin(F.broadcast(summary))  # one row


@query('SELECT doc_id, source AS "meta/source", lang AS "meta/size/lang", n_chars AS "meta/size/n" FROM documents')
def y10_flattened(spark: SparkSession, sf: str) -> DataFrame:
    size = F.struct("lang", F.col("n_chars").alias("n")).alias("size")
    return batch.flattened(table(spark, sf, "documents").select("doc_id", F.struct("source", size).alias("meta")))


@query("SELECT o_orderkey, (o_orderkey % 7)::BIGINT AS made, 2::BIGINT AS n FROM orders UNION ALL SELECT o_orderkey, (o_orderkey % 5)::BIGINT, 4::BIGINT FROM orders")
def z9_reused_dump(spark: SparkSession, sf: str) -> DataFrame:
    """A second run of the same shape reads the first one's dump; one with more responses makes its own."""
    out, rows = scratch(spark), table(spark, sf, "orders")

    def run(n: int, by: int) -> DataFrame:
        return io.dumped_or_made(spark, out, "trial", 64, n, lambda: rows.select("o_orderkey", (F.col("o_orderkey") % by).cast("bigint").alias("made"), F.lit(n).cast("bigint").alias("n")))

    run(2, 7)
    return run(2, 3).unionByName(run(4, 5))
