"""Queries: LaTeX read as text, mathematical equality, and the scores that rest on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import equality as E
from sievework.functions.final_answer import boxed_format_score
from sievework.plans.standins import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """An order's answer and truth in one of eight forms over two numbers a and b of its own; each seventh is wrong."""
    a, b = F.col("o_custkey") % 19 + 2, F.col("o_orderkey") % 23 + 1
    off = F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)
    kind = F.col("o_orderkey") % 8

    def form(pattern: str, *values: Column) -> Column:
        return F.format_string(pattern, *(v.cast("bigint") for v in values))

    given = (
        F.when(kind == 0, form("(x+%d)(x-%d)", a, b)).when(kind == 1, form("\\frac{%d}{%d}", a, b)).when(kind == 2, form("%d.0", a))
        .when(kind == 3, form("\\sqrt{%d}", 2 * a * a)).when(kind == 4, form("(%d, \\frac{%d}{2} y)", a, b))
        .when(kind == 5, form("\\begin{pmatrix} %d & %d \\\\ 1 & 2 \\end{pmatrix}", a, b)).when(kind == 6, form("\\frac{x^2-%d}{x-%d}", a * a, a))
        .otherwise(form("%d\\pi", a))
    )
    truth = (
        F.when(kind == 0, form("x^2+(%d)*x-%d", a - b, a * b + off)).when(kind == 1, form("%d/%d", 3 * a, 3 * b + off)).when(kind == 2, form("%d", a + off))
        .when(kind == 3, form("%d\\sqrt{2}", a + off)).when(kind == 4, form("(%d, 0.5*%d*y)", a, b + off)).when(kind == 5, form("[[%d, %d], [1, 2]]", a, b + off))
        .when(kind == 6, form("x+%d", a + off)).otherwise(form("\\pi*%d", a + off))
    )
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), given.alias("given"), truth.alias("truth"))


ANSWERS = """o AS (SELECT o_orderkey, o_custkey % 19 + 2 AS a, o_orderkey % 23 + 1 AS b, o_orderkey % 7 <> 0 AS ok, o_orderkey % 8 AS kind FROM orders)"""


@query(f"WITH {ANSWERS} SELECT o_orderkey, ok AS lenient, ok AND kind NOT IN (1, 5, 6) AS strict FROM o")
def t19_t20_equality(spark: SparkSession, sf: str) -> DataFrame:
    """To the lenient grader alone are fractions that aren't written alike, matrices, and fractions of sums, which plain
    text shows without brackets, equal."""
    g = (F.col("given"), F.col("truth"))
    return answers(spark, sf).select("o_orderkey", E.is_math_equal(*g).alias("lenient"), E.is_graded_equal(*g).alias("strict"))


@query(f"""WITH {ANSWERS} SELECT o_orderkey, CASE WHEN ok AND kind NOT IN (1, 5, 6) THEN 0.9 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 0.1 ELSE 0 END::DOUBLE AS shaped,
  ok AS prime, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy FROM o""")
def r13_r14_r17_v10_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with a box, every second one with thoughts before it; truths that can't be read give no accuracy."""
    box = F.concat(F.lit("\\boxed{"), "given", F.lit("}"))
    reply = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("<think>a</think> "), box)).otherwise(box)
    gold = F.when(F.col("o_orderkey") % 5 == 0, F.lit("== none")).otherwise(F.concat(F.lit("$"), "truth", F.lit("$")))
    rows = answers(spark, sf).withColumns({"reply": reply, "gold": gold})
    prime = E.is_correct(F.col("given"), F.col("truth"))
    return rows.select("o_orderkey", boxed_format_score(F.col("reply"), F.col("truth")).alias("shaped"), prime.alias("prime"), E.accuracy_reward(F.col("reply"), F.col("gold")).alias("accuracy"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_custkey || '/sqrt( ' || o_orderkey || '/7)' WHEN 1 THEN o_custkey || '+3/4/5' WHEN 2 THEN 'α^' || o_custkey || ' + pi'
  WHEN 3 THEN 'x' || o_custkey || '≤ inf' WHEN 4 THEN 'sqrt(sqrt( 1/sqrt(' || o_custkey || ')))' ELSE '(1,' || o_custkey || ')u[2,3]' END AS answer FROM orders""")
def x24_latex_text(spark: SparkSession, sf: str) -> DataFrame:
    """Nested and unknown commands, Greek letters, symbols and roots of roots."""
    n, kind = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 6
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    given = (
        F.when(kind == 0, text("\\dfrac{", n, "}{\\sqrt{\\frac{", F.col("o_orderkey").cast("string"), "}{7}}}")).when(kind == 1, text("$", n, "\\frac{\\frac{3}{4}}{5}$"))
        .when(kind == 2, text("\\alpha^{", n, "} + \\pi")).when(kind == 3, text("\\mathbf{x}\\unknown{", n, "}\\leq \\infty"))
        .when(kind == 4, text("\\sqrt{\\sqrt[3]{\\frac{1}{\\sqrt{", n, "}}}}")).otherwise(text("\\left(1,", n, "\\right)\\cup\\left[2,3\\right]"))
    )
    return table(spark, sf, "orders").select("o_orderkey", E.plain(given).alias("answer"))
