"""Queries: gathered groups, resumed steps, a curriculum, packed test cases and drawn expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.arrays import let
from sievework.operators.batch import with_row_id
from sievework.operators.expressions import random_expression
from sievework.plans.extras import scratch
from sievework.plans.standins import table
from sievework.sources import blobs
from sievework.streaming import flows
from sievework.streaming.resumable import StepLog, curriculum, resumed_batches

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS b, o_orderpriority FROM orders),
g AS (SELECT b, o_custkey FROM o GROUP BY ALL HAVING count(DISTINCT o_orderpriority) > 1),
f AS (SELECT o_custkey, min(b) AS b FROM g GROUP BY o_custkey), w AS (SELECT *, row_number() OVER (ORDER BY b, o_custkey) AS i FROM f)
SELECT o_orderkey, o_custkey, b::BIGINT AS batch FROM (SELECT o_orderkey, o_custkey, w.b, i, row_number() OVER (ORDER BY w.b, o_custkey, o_orderkey) AS r FROM o JOIN w USING (b, o_custkey) WHERE i <= (SELECT count(*) FROM customer) // 3)
WHERE r <= (SELECT count(*) FROM customer) // 2""")
def z1_gathered_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Customers are groups, orders come in four batches; groups whose priorities are all equal are filtered. A third as
    many groups as customers are gathered, and half as many rows taken of them."""
    out, orders = scratch(spark), table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf, "customer").count()
    for step in range(4):  # a file a batch, the older first
        orders.where(F.col("o_orderkey") % 4 == step).coalesce(1).write.mode("append").parquet(f"{out}/in")
    stream = flows.growing_source(spark, f"{out}/in", "o_orderkey long, o_custkey long, o_orderpriority string")

    def mixed(batch: DataFrame) -> DataFrame:
        found = batch.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n")).where("n > 1")
        return batch.join(found.select("o_custkey"), "o_custkey", "left_semi")

    flows.accumulate_groups(stream, "o_custkey", customers // 3, f"{out}/held", f"{out}/state", mixed, most=4).awaitTermination()
    taken = flows.accumulated(spark, f"{out}/held", customers // 2, "o_custkey", "o_orderkey")
    return taken.select("o_orderkey", "o_custkey", F.col("batch").cast("long").alias("batch"))


@query("""WITH RECURSIVE w AS (SELECT 0 AS step, c_custkey, c_acctbal::DOUBLE AS weight, false AS taken, NULL::DOUBLE AS before FROM customer UNION ALL
SELECT step + 1, c_custkey, CASE WHEN r <= 100 THEN weight * 0.5 - 10 ELSE weight + 1 END, r <= 100, weight FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, c_custkey) AS r FROM w) WHERE step < 5)
SELECT (step - 1)::BIGINT AS step, c_custkey, round(before, 6) AS weight FROM w WHERE taken""")
def z4_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    """Five batches of 100; what is taken loses weight and the rest gains. The second call goes on after a stop."""
    out, rows = scratch(spark), table(spark, sf, "customer")

    def run(steps: int) -> DataFrame:
        return curriculum(rows, "c_custkey", F.col("c_acctbal"), 100, steps, out, lambda w, taken: F.when(taken, w * 0.5 - 10).otherwise(w + 1))

    run(2)
    return run(5).select("step", "c_custkey", F.round("weight", 6).alias("weight"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // ((SELECT count(*) FROM orders) // 6))::BIGINT AS step FROM orders")
def z7_resumed_steps(spark: SparkSession, sf: str) -> DataFrame:
    """A run that stops after three steps, in the midst of the fourth, and one that goes on to the end."""
    log = StepLog(spark, scratch(spark))
    rows = with_row_id(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    batch = rows.count() // 6
    for step, some in resumed_batches(rows, batch, log):
        if step == 3:
            some.where("row_id % 2 = 0").write.parquet(log.folder(step))  # written but not committed
            break
        log.commit(step, some)
    for step, some in resumed_batches(rows, batch, StepLog(spark, log.path)):
        log.commit(step, some)
    return log.read_all().select("o_orderkey", "step")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS input, CASE WHEN doc_id % 7 <> 0 THEN lang END AS output, CASE WHEN doc_id % 7 <> 0 THEN 2::BIGINT END AS n FROM documents""")
def s19_packed_tests(spark: SparkSession, sf: str) -> DataFrame:
    """A public test and a private one, plain or packed, packed together and read again. Each seventh private field is a
    pickle that names a function: it gives null."""
    case = lambda i, o: F.to_json(F.array(F.struct(i.alias("input"), o.alias("output"))), {"ignoreNullFields": "false"})
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text", case(F.lit("1"), F.lit("2")).alias("public"), case(F.col("text"), F.col("lang")).alias("private"))
    planted = F.lit("eJxrYJkqwgABPawF+cWZFVN62NJTS5LLU6ZMnqIHAHf4CX8=")
    given = docs.withColumn("private", F.when(F.col("doc_id") % 7 == 0, planted).when(F.col("doc_id") % 3 == 0, F.col("private")).otherwise(blobs._each(blobs.packed, F.col("private"))))
    made = blobs.with_packed_tests(given, "public", "private", F.lit(None).cast("string"), "packed")
    read = F.from_json(blobs._each(blobs.unpacked, F.col("packed")), "inputs array<string>, outputs array<string>, fn_name string")
    return made.select("doc_id", read.alias("r")).select("doc_id", F.col("r.inputs")[1].alias("input"), F.col("r.outputs")[1].alias("output"), F.when(F.col("r").isNotNull(), F.size("r.inputs")).cast("bigint").alias("n"))


def _drawn(what: str, place: str, low: int, high: int) -> str:
    return f"({low} + floor(('0x' || substr(md5('42:' || o_orderkey || ':{what}:' || {place}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * {high - low}))::BIGINT"


def _expression(place: str, left: int) -> str:
    """A struct of text and value, as ``random_expression`` draws it."""
    i, at = f"i{left}", f"({place} || '.' || i{left})"
    number = _drawn("number", at, 1, 10)
    term = f"{{'t': {number}::VARCHAR, 'v': {number}}}"
    if left:
        inner = _expression(at, left - 1)
        term = f"CASE WHEN {_drawn('nested', at, 0, 2)} = 1 THEN list_transform([{inner}], lambda e{left}: {{'t': '(' || e{left}.t || ')', 'v': e{left}.v}})[1] ELSE {term} END"
    parts = f"list_transform(range(1, {_drawn('terms', place, 2, 6)} + 1), lambda {i}: {term})"
    x = f"x{left}"
    return (
        f"list_transform([{parts}], lambda {x}: {{'t': array_to_string(list_transform({x}, lambda p{left}: p{left}.t), ' @ '), "
        f"'v': list_reduce(list_transform({x}, lambda q{left}: q{left}.v), lambda a{left}, b{left}: 3 * a{left} - 2 * b{left})}})[1]"
    )


@query(f"SELECT o_orderkey, e.t AS expression, e.v AS value FROM (SELECT o_orderkey, {_expression(chr(39) + 'r' + chr(39), 2)} AS e FROM orders)")
def p23_expressions(spark: SparkSession, sf: str) -> DataFrame:
    """An expression per order in an operator that stands for three times the left less twice the right side."""
    drawn = let(random_expression(F.col("o_orderkey")), lambda e: e)
    return table(spark, sf, "orders").select("o_orderkey", drawn.alias("e")).select("o_orderkey", F.col("e.text").alias("expression"), F.col("e.value").alias("value"))
