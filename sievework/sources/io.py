"""Readers and writers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def prompts_and_responses(df: DataFrame, prompt: list[str], response: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """prompt and response, drilled out of nested columns by lists of keys, after the columns to ``keep``."""
    drill = lambda keys: reduce(lambda c, k: c.getField(k), keys[1:], F.col(keys[0]))
    return df.select(*keep, drill(prompt).alias("prompt"), drill(response).alias("response"))


def preference(df: DataFrame) -> DataFrame:
    return df.select("prompt", "chosen", "rejected")


def conversations(df: DataFrame) -> DataFrame:
    """messages, tools and enable_thinking; columns that aren't there are null."""
    kinds = {"tools": "string", "enable_thinking": "boolean"}
    return df.select("messages", *(F.col(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))


def jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def masked_fields(df: DataFrame, pattern: str, mark: str) -> DataFrame:
    """String fields with a pattern masked, other fields as JSON text."""
    show = lambda c, kind: F.regexp_replace(c, pattern, mark) if kind == "string" else F.to_json(F.struct(F.col(c).alias("v")))
    return df.select(*(show(c, kind).alias(c) for c, kind in df.dtypes))


def numbered_steps(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """JSON lines of files whose stem is a number, as ``step``."""
    rows = spark.read.schema(schema).json(f"{folder}/*.jsonl")
    return rows.withColumn("step", F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]+)\.", 1).cast("bigint"))


def tests_by_problem(df: DataFrame, problem: str, case: str, given: str, wanted: str) -> DataFrame:
    """problem, tests: a map from case to (input, output)."""
    entry = F.struct(F.col(case), F.struct(F.col(given).alias("input"), F.col(wanted).alias("output")))
    return df.groupBy(problem).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tests"))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_step(df: DataFrame, path: str, step: int, extra: dict[str, Column] | None = None) -> None:
    """JSON lines of a step, in a folder of its own; a rerun of the step replaces it."""
    df.withColumns(extra or {}).write.mode("overwrite").json(f"{path}/step={step}")


def stringified(df: DataFrame, form: str = "yyyy-MM-dd'T'HH:mm:ss") -> DataFrame:
    """Timestamps at any depth of a row as text, by way of JSON."""
    return df.select(F.to_json(F.struct(*df.columns), {"timestampFormat": form, "timestampNTZFormat": form}).alias("json"))


def write_evaluation(metrics: DataFrame, results: DataFrame, path: str) -> None:
    """The one row of ``metrics`` as ``{"metrics": {...}}``, and ``results`` as JSON lines beside it."""
    metrics.select(F.struct(*metrics.columns).alias("metrics")).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    results.write.mode("overwrite").json(f"{path}/results")


def dumped_or_made(spark: SparkSession, folder: str, name: str, size: int, n: int, make: Callable[[], DataFrame]) -> DataFrame:
    """The dump of an earlier run with the same name, batch size and number of responses; where there is none,
    ``make()``, which is written first. A dump counts from its commit mark on, so that a broken one is made again."""
    path = f"{folder}/{name}_GBS{size}__N{n}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
