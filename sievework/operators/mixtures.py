"""Weighted mixtures, splits and resampling, by seeded hash order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.batch import concat, with_row_id
from sievework.operators.metrics import hashed_unit

#: Rows up to which a top-k, which ends in one task, picks the first.
MOST_IN_A_TASK = 1_000_000


def hash_order(seed: int, *keys: str) -> Column:
    """A text by which rows are in seeded order: the md5 of seed and keys, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *(F.col(k).cast("string") for k in keys)))


def first_by_hash(df: DataFrame, n: int, seed: int, key: str, rows: int | None = None) -> DataFrame:
    """``n`` rows in seeded order, of ``rows`` if their number is known. Hashes are even, so that a limit to them leaves
    little more than ``n`` rows of any number; where repeated keys leave fewer, the limit is raised. Up to a number that
    fits a task a top-k of these does; beyond, rows are numbered in ranges of the order."""
    ordered = df.withColumn("hash_", hash_order(seed, key)).withColumn("place_", F.struct("hash_", key))
    if n > MOST_IN_A_TASK:
        return with_row_id(ordered, "place_").where(F.col("row_id") < n).drop("hash_", "place_", "row_id")
    share = (n + 8 * math.sqrt(n) + 64) / max(1, df.count() if rows is None else rows)
    few = ordered
    while share < 0.5:
        # the first 15 of 32 hexadecimal digits
        few = ordered.where(F.col("hash_") < f"{int(share * (1 << 60)):015x}")
        if few.count() >= n:
            break
        share, few = 4 * share, ordered
    return few.orderBy("place_").limit(n).drop("hash_", "place_")


def mixture(sources: list[tuple[DataFrame, float | None]], key: str, columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """``int(rows * weight)`` rows of each source in seeded order, or all of one without a weight; sources must have
    the same columns."""
    picked, names = [], None
    for df, weight in sources:
        df = df.select(*columns) if columns else df
        if names is not None and set(df.columns) != names:
            raise ValueError("the sources' columns differ")
        names = set(df.columns)
        rows = None if weight is None else df.count()
        picked.append(df if rows is None else first_by_hash(df, int(rows * weight), seed, key, rows))
    if not picked:
        raise ValueError("a mixture needs a source")
    return concat(picked)


def train_test_split(df: DataFrame, test: float, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    """Exact sizes: the first rows in seeded order, rounded up, test."""
    rows = df.count()
    held = first_by_hash(df, math.ceil(rows * test - 1e-9), seed, key, rows)
    return df.join(held.select(key), key, "left_anti"), held


def resampled(df: DataFrame, weight: Column, n: int, seed: int, order: str) -> DataFrame:
    """``n`` draws with replacement by weight, with ``draw`` from 0: uniform numbers meet the running sum of weights.
    The sum is taken in ranges of the order, and a draw finds its range by an equi-join on a bin of the unit interval;
    bins grow with rows and draws, so that a bin meets some thousand of each."""
    bins = max(4096, max(df.count(), n) // 1024)
    rows = with_row_id(df.withColumn("w", weight + 1e-8), order)
    bucket = F.pmod(F.col("row_id"), F.lit(1 << 62)).cast("long")
    sums = rows.groupBy((bucket / 4096).cast("long").alias("g")).agg(F.sum("w").alias("gw"))
    # neighbours share their bound to the last bit, within a range by equal running sums and between ranges by its end
    ranges = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = sums.withColumn("after", F.sum("gw").over(ranges)).withColumn("before", F.coalesce(F.lag("after").over(Window.orderBy("g")), F.lit(0.0)))
    total = before.agg(F.max("after").alias("total"))
    placed = rows.withColumn("g", (bucket / 4096).cast("long")).join(before.select("g", "before", "after"), "g").crossJoin(F.broadcast(total))
    own = Window.partitionBy("g").orderBy("row_id")
    running = F.col("before") + F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumn("running", F.when(F.lead("row_id").over(own).isNull(), F.col("after")).otherwise(F.least(running, "after")))
    placed = placed.withColumn("low", F.coalesce(F.lag("running").over(own), "before") / F.col("total")).withColumn("high", F.col("running") / F.col("total"))
    spread = placed.withColumn("bin", F.explode(F.sequence(F.floor(F.greatest(F.lit(0.0), F.col("low")) * bins), F.least(F.lit(bins - 1).cast("bigint"), F.floor(F.col("high") * bins)))))
    draws = df.sparkSession.range(n).withColumn("u", hashed_unit(F.lit(seed), F.col("id"))).select(F.col("id").alias("draw"), "u", F.floor(F.col("u") * bins).alias("bin"))
    hit = draws.join(spread, "bin").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return hit.select("draw", *df.columns)
