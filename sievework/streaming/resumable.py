"""Steps that survive a stop: a log of committed steps, and a curriculum whose weights change with every batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class StepLog:
    """A folder with one folder per step and a marker, a file named for the latest committed step. A step's rows are
    written first and its marker is created by one rename, so that a step either counts as a whole or is done again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The last committed step, -1 before any."""
        folder = self.hadoop.Path(f"{self.path}/committed")
        if not self.fs.exists(folder):
            return -1
        names = [str(f.getPath().getName()) for f in self.fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def commit(self, step: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.folder(step))
        self.fs.mkdirs(self.hadoop.Path(f"{self.path}/committed"))
        draft = self.hadoop.Path(f"{self.path}/_draft-{step}")
        self.fs.create(draft, True).close()
        self.fs.rename(draft, self.hadoop.Path(f"{self.path}/committed/{step}"))

    def folder(self, step: int) -> str:
        return f"{self.path}/steps/step={step}"

    def read(self, step: int) -> DataFrame:
        return self.spark.read.parquet(self.folder(step))

    def read_all(self) -> DataFrame:
        """The rows of all committed steps, with ``step``."""
        rows = self.spark.read.option("basePath", f"{self.path}/steps").parquet(*(self.folder(k) for k in range(self.latest() + 1)))
        return rows.withColumn("step", F.col("step").cast("long"))


def resumed_batches(rows: DataFrame, batch: int, log: StepLog) -> Iterator[tuple[int, DataFrame]]:
    """Number and rows of each batch of ``rows`` (with ``row_id``) that isn't committed yet, in order; the position is
    the number of committed steps times ``batch``, so that no row is lost or taken twice."""
    last = rows.agg(F.max("row_id")).first()[0]
    step = log.latest() + 1
    while last is not None and step * batch <= last:
        yield step, rows.where((F.col("row_id") >= step * batch) & (F.col("row_id") < (step + 1) * batch))
        step += 1


def curriculum(rows: DataFrame, key: str, weight: Column, batch: int, steps: int, path: str, update: Callable[[Column, Column], Column]) -> DataFrame:
    """step, key, weight of the rows taken in each of ``steps`` batches: those of the greatest weight, ties by key.
    After a batch ``update`` makes new weights of the old ones and of whether a row was taken. Weights are a table per
    step in a ``StepLog`` under ``path``; a call that finds steps there goes on after the last one."""
    log = StepLog(rows.sparkSession, path)
    if log.latest() < 0:
        log.commit(0, rows.select(key, weight.cast("double").alias("weight"), F.lit(False).alias("taken"), F.lit(None).cast("double").alias("before")))
    for step in range(log.latest() + 1, steps + 1):
        now = log.read(step - 1).select(key, "weight")
        chosen = now.orderBy(F.desc("weight"), key).limit(batch).select(key, F.lit(True).alias("taken"))
        met = now.join(chosen, key, "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
        log.commit(step, met.select(key, update(F.col("weight"), F.col("taken")).alias("weight"), "taken", F.col("weight").alias("before")))
    return log.read_all().where("taken").select((F.col("step") - 1).alias("step"), key, F.col("before").alias("weight"))
