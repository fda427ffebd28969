"""Structured Streaming: growing sources, carried state and per-step dumps."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.shipping import ship


def growing_source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files that are added to a folder; each batch takes new ones."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def step_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Mean score per step of JSON dumps that keep coming."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.groupBy("step").agg(F.count("*").alias("rows"), F.avg("score").alias("score"))


def accumulate_groups(stream: DataFrame, key: str, wanted: int, target: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame], most: int = 0) -> StreamingQuery:
    """Filtered groups of each batch are appended to ``target`` until ``wanted`` groups are there; later batches add
    nothing. A batch writes to a folder of its own, so that a repeated batch replaces itself. If ``most`` batches have
    passed without enough groups, the query fails; batches are numbered by the checkpoint, so that a restart counts on."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        good = keep(batch)
        try:
            held = spark.read.parquet(target).where(F.col("batch") < number).select(key).distinct()
            n = held.count()
            good = good.join(held, key, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            n = 0
        if n < wanted:
            groups = good.select(key).distinct().orderBy(key).limit(wanted - n)
            good.join(groups, key, "left_semi").write.mode("overwrite").parquet(f"{target}/batch={number}")
            if most and number + 1 >= most:
                n = spark.read.parquet(target).where(F.col("batch") <= number).select(key).distinct().count()
                if n < wanted:
                    raise RuntimeError(f"{n} of {wanted} groups after {number + 1} batches")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, target: str, rows: int, *order: str) -> DataFrame:
    """The first ``rows`` rows that ``accumulate_groups`` has gathered, by batch and ``order``."""
    held = spark.read.parquet(target)
    return held.orderBy("batch", *order).limit(rows)


def adaptive_coefficient(stream: DataFrame, start: float, target: float, horizon: int) -> DataFrame:
    """run, steps, beta: the KL coefficient of each run after the steps (run, step, kl, n) of a batch, as carried state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        beta, steps = state.get if state.exists else (start, 0)
        rows = pd.concat(list(batches)).sort_values("step")
        for kl, n in zip(rows["kl"], rows["n"]):
            beta *= 1 + min(0.2, max(-0.2, kl / target - 1)) * n / horizon
            steps += 1
        state.update((beta, steps))
        yield pd.DataFrame({"run": [key[0]], "steps": [steps], "beta": [beta]})

    ship(stream.sparkSession)
    return stream.groupBy("run").applyInPandasWithState(update, "run long, steps long, beta double", "beta double, steps long", "update", "NoTimeout")


def windowed_rewards(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An addition to what a training loop needs: mean value per event type and time window, with late rows dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a stream has by now, through a memory table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
