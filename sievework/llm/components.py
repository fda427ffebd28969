"""Connected components: each task joins the edges at its hand, then alternating large and small stars join what the
tasks found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import cut, map_arrow

#: Edges that a task joins in memory at once; as few as that are joined by one task, more by stars.
TASK_EDGES = 1 << 18


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over ``pairs`` (u, v), u > v. Minima are aggregated in parts and joined back, so that a node with
    many neighbours is no single task's work."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("mu", "m").alias("m"))
    joined = both.join(least, both["u"] == least["mu"])
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("mu").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v) that aren't their component's smallest, and that smallest node."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(ids))
    while True:
        least, lower = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(lower, label[a], least)
        np.minimum.at(lower, label[b], least)
        while not np.array_equal(lower, lower[lower]):
            lower = lower[lower]
        if np.array_equal(lower, label):
            return ids[label != np.arange(len(ids))], ids[label[label != np.arange(len(ids))]]
        label = lower


def _contracted(pairs: DataFrame, limit: int) -> DataFrame:
    """``pairs`` (u, v) with every ``limit`` edges of a task replaced by stars around their smallest nodes."""

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(u, v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                if rows + part.num_rows > limit:
                    yield joined(held)
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield joined(held)

    return map_arrow(pairs, run, "u long, v long")


def components(edges: DataFrame, limit: int = TASK_EDGES) -> DataFrame:
    """node, component (the smallest node reached) of every node of ``edges`` (a, b: long, read twice) but the smallest
    ones. Repeated edges and loops do no harm; no edge gives no row."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if pairs.count() > limit:
        pairs = cut(_contracted(pairs, limit).distinct())
        seen = None
        while True:
            state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == seen:
                return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
            if state[0] <= limit:
                break
            seen = state
            pairs = cut(_star(_star(pairs, True), False))
    whole = _contracted(pairs.coalesce(1), limit)
    return whole.select(F.col("u").alias("node"), F.col("v").alias("component"))
