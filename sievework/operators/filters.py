"""Row filters: lengths, rates, contamination, resume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import normalize_string, word_ngrams

#: Distinct eval grams up to which they are broadcast to the corpus.
BROADCAST_GRAMS = 500_000


def grams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """key, gram: the distinct word n-grams of each text; none for shorter texts."""
    words = df.select(F.col(key), F.split(normalize_string(F.col(text)), " ").alias("w")).where(F.size("w") >= n)
    return words.select(key, F.explode(F.array_distinct(word_ngrams(F.col("w"), n))).alias("gram"))


def ngram_lookup(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """gram, items: the inverted index, ids in order."""
    return grams(df, key, text, n).groupBy("gram").agg(F.array_sort(F.collect_set(key)).alias("items"))


def flag_contaminated(docs: DataFrame, key: str, text: str, evals: dict[str, DataFrame], eval_text: str = "text", n: int = 8) -> DataFrame:
    """A boolean column per eval set: the document shares a gram with it. The corpus is exploded once, against the grams
    of all sets, which are broadcast after a count; else both sides are shuffled. Keys meet their flags by one join. A null
    key is never flagged."""
    if not evals:
        return docs
    listed = [grams(items.withColumn("set_", F.lit(i)), "set_", eval_text, n) for i, items in enumerate(evals.values())]
    wanted = reduce(DataFrame.unionByName, listed).groupBy("gram").agg(F.collect_set("set_").alias("sets"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_GRAMS else wanted
    flags = [F.max(F.array_contains("sets", i)).alias(name) for i, name in enumerate(evals)]
    hit = grams(docs, key, text, n).join(wanted, "gram").groupBy(key).agg(*flags)
    out = docs.join(hit, key, "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(False)) for name in evals})


def cleanup(df: DataFrame, flags: list[str]) -> DataFrame:
    for flag in flags:
        df = df.where(~F.col(flag))
    return df.drop(*flags)


def pass_rate(df: DataFrame, rewards: str, low: float, high: float) -> DataFrame:
    """Rows whose mean reward, nulls left out, lies strictly between the bounds."""
    known = F.filter(rewards, lambda r: r.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, r: a + r), F.size(known))
    return df.withColumn("pass_rate", mean).where((F.col("pass_rate") > low) & (F.col("pass_rate") < high))


def out_of_knowledge(df: DataFrame, judge: str) -> DataFrame:
    """Rows with no verdict of 1; without any verdict too."""
    return df.where(~F.coalesce(F.exists(judge, lambda v: F.coalesce(v["score"] == 1, F.lit(False))), F.lit(False)))


def string_window(df: DataFrame, column: str, low: str, high: str) -> DataFrame:
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def varied_groups(df: DataFrame, key: str, score: str) -> DataFrame:
    """Groups whose scores differ, and groups of one."""
    per = df.groupBy(key).agg(F.stddev_pop(score).alias("sd"), F.count("*").alias("n")).where("sd > 0 OR n = 1").select(key)
    return df.join(per, key, "left_semi")


def filter_and_downsample(df: DataFrame, key: str, score: str, length: str, band: tuple[float, float], longest: int, oversample: int, order: str) -> DataFrame:
    """Groups within the accuracy band (inclusive) and shorter than ``longest`` - 1 come first; 1 / ``oversample`` of
    the rows are taken. ``ok`` tells whether a row's group passes."""
    per = df.groupBy(key).agg((F.avg(score).between(*band) & (F.max(length) < longest - 1)).alias("ok"))
    n = df.count() // oversample
    return df.join(per, key).orderBy(F.desc("ok"), key, order).limit(n)


def range_select(rows: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Rows of ``row_id`` from ``start`` to before ``end``, if both are given."""
    return rows if start is None or end is None else rows.where((F.col("row_id") >= start) & (F.col("row_id") < end))


def resume(df: DataFrame, key: str, done: DataFrame, hash_column: str) -> DataFrame:
    """Rows whose md5 of the key isn't among those done."""
    return df.withColumn(hash_column, F.md5(F.col(key).cast("string"))).join(done, hash_column, "left_anti").drop(hash_column)


def reference_kept(first: Column, first_least: float, second: Column, second_least: float) -> Column:
    return F.when(first.isNotNull(), first >= first_least).when(second.isNotNull(), second >= second_least).otherwise(True)


def within_budget(df: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Rows in order until the next would exceed the budget."""
    upto = F.sum(size).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("upto", upto).where(F.col("upto") <= most).drop("upto")
