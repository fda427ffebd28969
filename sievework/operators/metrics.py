"""Batch and validation metrics."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.batch import with_row_id


def explained_variance(returns: Column, values: Column) -> Column:
    """1 - var(returns - values) / (var(returns) + 1e-5), with sample variances; an aggregate."""
    return 1.0 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)


def reduce_metrics(long: DataFrame) -> DataFrame:
    """metric, value rows to one value per metric: the maximum if the name holds ``max``, else the minimum if it holds
    ``min``, else the mean."""
    m = F.col("metric")
    value = F.when(F.contains(m, F.lit("max")), F.max("value")).when(F.contains(m, F.lit("min")), F.min("value")).otherwise(F.avg("value"))
    return long.groupBy("metric").agg(value.alias("value"))


def majority(df: DataFrame, keys: list[str], vote: str, value: str, order: str) -> DataFrame:
    """Of the most frequent vote per group the value of its first occurrence; ties go to the vote seen first."""
    votes = df.groupBy(*keys, vote).agg(F.count("*").alias("n"), F.min(F.struct(order, value)).alias("first"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("b"))
    return best.select(*keys, F.col(f"b.first.{value}").alias("majority"))


def best_of_k(df: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The earliest row of the highest score per group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), order))).where("place = 1").drop("place")


def expected_best(df: DataFrame, keys: list[str], score: str, n: int, worst: bool = False) -> DataFrame:
    """The mean of the best (worst) of ``n`` draws with replacement, in closed form: with scores in order, the chance
    that the i-th of m is the best is (i/m)^n - ((i-1)/m)^n. It is what a bootstrap estimates."""
    w = Window.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(F.desc(score) if worst else F.asc(score)))
    share = lambda k: F.pow(k / F.count("*").over(w), F.lit(float(n)))
    return df.withColumn("chance", share(i) - share(i - 1)).groupBy(*keys).agg(F.sum(F.col("chance") * F.col(score)).alias("expected"))


def hashed_unit(*parts: Column) -> Column:
    """A number of [0, 1) from 52 bits of the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def bootstrap(df: DataFrame, keys: list[str], value: str, order: str, size: int, reducers: dict[str, Callable[[Column], Column]], draws: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and population deviation of each reducer, an aggregate, over ``draws`` resamples of ``size`` rows with
    replacement. Rows are numbered over all groups in ``order``; a resample picks numbers by hashes of its place, and
    picks meet rows by number, so that a group of any size costs ``draws * size`` picks and is no single task's work."""
    placed = with_row_id(df.select(*keys, F.col(value).alias("value_"), F.struct(*keys, order).alias("place_")), "place_")
    groups = placed.groupBy(*keys).agg(F.count("*").alias("rows_"), F.min("row_id").alias("first_"))
    picks = groups.withColumn("draw_", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("slot_", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    at = F.floor(hashed_unit(F.lit(seed), *map(F.col, [*keys, "draw_", "slot_"])) * F.col("rows_"))
    picks = picks.select(*keys, "draw_", (F.col("first_") + at).alias("row_id"))
    each = picks.join(placed.select("row_id", "value_"), "row_id").groupBy(*keys, "draw_").agg(*(f(F.col("value_")).alias(name) for name, f in reducers.items()))
    return each.groupBy(*keys).agg(*(f(name).alias(f"{name}_{what}") for name in reducers for what, f in (("mean", F.avg), ("std", F.stddev_pop))))


def histogram(df: DataFrame, value: str, bins: list[tuple[int, int]]) -> DataFrame:
    """Closed ranges with their count and percent of all rows; ranges may overlap."""
    counts = [F.count_if(F.col(value).between(a, b)).alias(f"{a}-{b}") for a, b in bins]
    totals = df.agg(F.count("*").alias("n"), *counts)
    names = ", ".join(f"'{a}-{b}', `{a}-{b}`" for a, b in bins)
    return totals.selectExpr("n", f"stack({len(bins)}, {names}) AS (bin, count)").select("bin", "count", F.round(100 * F.col("count") / F.col("n"), 2).alias("percent"))


def pair_agreement(df: DataFrame, key: str, score: str, acc: str) -> DataFrame:
    """Per group the share of pairs, weighted by their difference in accuracy, whose scores are in the same order; 0.5
    without a difference. No pair is made: two scores' ranks differ first in one bit, where they part into a left and a
    right half under a common prefix, so that for each bit and prefix running counts and sums in order of accuracy give
    the weight of all pairs that lie left and right. Equal (score, accuracy) are counted first; n log n rows in all."""
    some = df.where(F.col(acc).isNotNull()).groupBy(key, F.col(score).alias("s"), F.col(acc).cast("double").alias("a")).agg(F.count("*").alias("m"))

    def weight(cells: DataFrame, by: list[str], total: str) -> DataFrame:
        """The sum over ``right`` rows of their distance to all ``left`` ones of less accuracy."""
        run = Window.partitionBy(*by).orderBy("a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        each = F.col("right") * (F.col("a") * F.sum("left").over(run) - F.sum(F.col("left") * F.col("a")).over(run))
        return cells.withColumn("w", each).groupBy(key).agg(F.sum("w").alias(total))

    count = F.sum("m")
    every = weight(some.groupBy(key, "a").agg(count.alias("left"), count.alias("right")), [key], "every")
    group = Window.partitionBy(key)
    ranked = some.where(F.col("s").isNotNull()).withColumn("rank", (F.dense_rank().over(group.orderBy("s")) - 1).cast("long"))
    ranked = ranked.withColumn("bits", F.length(F.bin(F.max("rank").over(group))) - 1)
    bit = F.explode(F.sequence(F.lit(0), F.col("bits"))).alias("bit")
    halves = ranked.select(key, "a", "m", "rank", bit).withColumn("side", F.expr("(rank >> bit) & 1")).withColumn("prefix", F.expr("rank >> (bit + 1)"))
    cells = halves.groupBy(key, "bit", "prefix", "a").agg(F.sum(F.col("m") * (1 - F.col("side"))).alias("left"), F.sum(F.col("m") * F.col("side")).alias("right"))
    same = weight(cells, [key, "bit", "prefix"], "same")
    share = F.when(F.col("every") > 0, F.coalesce("same", F.lit(0.0)) / F.col("every"))
    return df.select(key).distinct().join(every, key, "left").join(same, key, "left").select(key, F.coalesce(share, F.lit(0.5)).alias("agreement"))


def console_line(metrics: Column, step: Column) -> Column:
    """``step:k - name:value - ...`` from an array of (metric, value)."""
    return F.concat_ws(" - ", F.concat(F.lit("step:"), step.cast("string")), F.transform(metrics, lambda m: F.concat(m["metric"], F.lit(":"), F.format_number(m["value"], 3))))


def from_console(line: Column, name: str) -> Column:
    """A metric of a console line; minus infinity without it."""
    found = F.filter(F.split(line, " - "), lambda p: p.startswith(f"{name}:"))
    return F.coalesce(F.replace(F.element_at(F.split(F.get(found, F.lit(0)), ":"), -1), F.lit(","), F.lit("")).cast("double"), F.lit(float("-inf")))


def validation(df: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """Per source the mean over prompts of mean@N, the population deviation, and the expected best and worst of N."""
    per = df.groupBy(source, prompt).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("best"), F.min(value).alias("worst"))
    return per.groupBy(source).agg(*(F.avg(c).alias(c) for c in ("mean", "std", "best", "worst")))


#: Explanations that the summary counts.
MISSING, UNBOXED, EXACT = "missing (no llm-as-a-judge applied)", "Evaluation Error: prediction not in \\boxed{} format", "exact match"


def evaluation_summary(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of counts and rates over the best attempt of each ``key`` (score, explanation): the highest score, and of
    equal ones the first by ``order``, then by explanation. An empty table has total 0 and null rates."""
    best = df.groupBy(key).agg(F.min_by(F.struct("score", "explanation"), F.struct(-F.col("score"), F.col(order), F.col("explanation"))).alias("b")).select("b.*")
    says = lambda x: F.count_if(F.col("explanation") == x)
    counted = best.agg(F.count("*").alias("total"), F.count_if(F.col("score") == 1).alias("n_correct"), says(MISSING).alias("n_miss"), says(UNBOXED).alias("n_no_boxed"), says(EXACT).alias("n_exact_match"))
    wrong = F.col("total") - F.col("n_correct") - F.col("n_miss")
    counted = counted.withColumns({"n_hallucination": wrong, "n_hallucination_boxed": wrong - F.col("n_no_boxed")})
    rate = lambda x: F.try_divide(x.cast("double"), F.col("total"))
    rates = {"accuracy": "n_correct", "missing": "n_miss", "em": "n_exact_match", "no_boxed": "n_no_boxed", "hallucination": "n_hallucination", "hallucination_boxed": "n_hallucination_boxed"}
    return counted.withColumns({"score": rate(2 * F.col("n_correct") + F.col("n_miss") - F.col("total")), **{k: rate(F.col(v)) for k, v in rates.items()}})
