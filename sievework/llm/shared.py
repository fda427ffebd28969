"""What several operators use: the shared folder, lineage cuts, deterministic range shards and file access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.shipping import ship

#: Words are runs of anything but these six ASCII characters.
SPACES = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bins, at least, of the id histogram from which range shards are cut.
RANGE_BINS = 4096
#: Range shards beyond which they grow instead: their bounds stand in the plan, and the driver holds bins for each.
MOST_SHARDS = 50_000
#: Rows and bytes of an Arrow batch between the JVM and its workers, where the session leaves Spark's defaults: both
#: sides hold whole batches outside the heap.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "1m")}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Only in local mode, where all are one
    process, a temporary one does."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.getConf().get("spark.checkpoint.dir") and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='sievework-')}")
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that no later step depends on an executor's disk."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words of a text; a null or blank text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{SPACES}+"))


def _place(key: str, starts: list[int]) -> Column:
    """The number of ``starts``, sorted, that are at most the long column ``key``, less one: a binary search."""
    table = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(table, at + step) <= F.col(key), F.lit(False)), at + step).otherwise(at)

    steps = [1 << b for b in range(len(starts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)


def range_shards(df: DataFrame, key: str, size: Column, target: int, most: int = MOST_SHARDS) -> tuple[Column, int, int]:
    """An int expression for the shard of a row, the number of shards, and their units: consecutive ranges of the long
    column ``key`` of about ``target`` units of ``size`` each, or more where the sizes would ask for more than ``most``
    shards. They depend on the rows only, so that a rerun cuts the same shards. Keys and sizes are kept as a slim table,
    so that the rows are read once. A histogram of equal widths is refined where a bin holds more than a fourth of
    the target, so that ids that lie far out don't crowd the others into a bin; only a single id can't be cut. The
    driver holds a number per bin: a few per shard, RANGE_BINS at least. Null keys go to shard 0."""
    slim = cut(df.select(F.col(key).alias("key_"), size.cast("long").alias("size_")))
    low, high, total = slim.agg(F.min("key_"), F.max("key_"), F.sum("size_")).first()
    target = max(target, (total or 0) // most)
    if low is None:
        return F.lit(0), 1, target
    sums, open_ = {}, [(low, high + 1)]  # weight by start of the bins that are done; bins to be cut, ends exclusive
    ends = {}
    while open_:
        each = max(2, RANGE_BINS // len(open_))
        widths = [max(1, -(-(b - a) // each)) for a, b in open_]
        starts = [a for a, _ in open_]
        numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
        rows = slim.where(F.col("key_").isNotNull()).withColumn("at", _place("key_", starts))
        of = {"begin": F.get(numbers(starts), F.col("at")), "width": F.get(numbers(widths), F.col("at")), "last": F.get(numbers([b - 1 for _, b in open_]), F.col("at"))}
        # a difference of two longs may pass 64 bits
        part = F.expr("CAST((CAST(key_ AS DECIMAL(38,0)) - begin) DIV width AS BIGINT)")
        rows = rows.withColumns(of).where("key_ BETWEEN begin AND last").withColumn("part", part)
        found = rows.groupBy("at", "part").agg(F.sum("size_").alias("n")).collect()
        again = []
        for r in sorted(found, key=lambda r: (r["at"], r["part"])):
            a = starts[r["at"]] + r["part"] * widths[r["at"]]
            b = min(a + widths[r["at"]], open_[r["at"]][1])
            if 4 * r["n"] > target and b - a > 1:
                again.append((a, b))
            else:
                sums[a], ends[a] = r["n"], b
        open_ = again
    bounds, filled = [], 0
    for a in sorted(sums):
        if not bounds or filled and filled + sums[a] > target:
            bounds.append(a)
            filled = 0
        filled += sums[a]
    return F.when(F.col(key).isNull(), 0).otherwise(F.greatest(F.lit(0), _place(key, bounds))), len(bounds), target


def filesystem(uri: str):
    """A pyarrow file system and the path on it; works for every scheme that pyarrow knows, on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_caches: dict[str, Callable[[], None]] = {}
_task_caches: dict[str, Callable[[], None]] = {}


def take_room(name: str, forget: Callable[[], None], for_task: bool = False) -> None:
    """Called by a worker's code before it fills a cache: other operators' caches in the same process are emptied.
    A cache ``for_task`` is emptied when its task ends, so that idle workers hold little."""
    for other, empty in _caches.items():
        if other != name:
            empty()
    _caches[name] = forget
    if for_task:
        _task_caches[name] = forget


def after_task(name: str, forget: Callable[[], None]) -> None:
    """``forget`` is called whenever a task ends."""
    _task_caches[name] = forget


def end_task() -> None:
    """Empties the task's caches and gives free memory back to the system, which a worker that is reused or idle would
    else hold beside the JVM."""
    for empty in _task_caches.values():
        empty()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    for key, (default, value) in ARROW.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, and the task's caches emptied at its end."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def wrapped(batches):
        from sievework.llm.shared import end_task

        try:
            yield from run(batches)
        finally:
            end_task()

    return df.mapInArrow(wrapped, schema)
