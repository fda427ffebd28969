"""Balanced partitions of sequence lengths, per batch.

Each batch is one group: batches are bounded by what a training step takes, and there are many of them, so that the
heaps below run in parallel over batches."""

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.shipping import ship


def largest_differencing(lengths: list[int], k: int, equal: bool) -> list[list[int]]:
    """k-way largest differencing: states with the widest spread are merged first, the largest set of one with the
    smallest of the other. With ``equal`` every part gets the same number of items, which k must divide. Ties are broken
    by sums, sizes and indices, so that the result is determined."""
    if equal and len(lengths) % k:
        raise ValueError(f"{len(lengths)} items don't make {k} equal parts")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))

    def state(items: list[int]) -> list[tuple[int, list[int]]]:
        sets = [(lengths[i], [i]) for i in items] + [(0, [])] * (k - len(items))
        return sorted(sets, key=lambda s: (s[0], len(s[1]), s[1]), reverse=True)

    starts = [order[i : i + k] for i in range(0, len(order), k)] if equal else [[i] for i in order]
    heap = []
    for n, items in enumerate(starts):
        sets = state(items)
        heap.append((sets[-1][0] - sets[0][0], -sets[0][0], n, sets))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[3], heapq.heappop(heap)[3]
        merged = [(x[0] + y[0], sorted(x[1] + y[1])) for x, y in zip(a, reversed(b))]
        merged.sort(key=lambda s: (s[0], len(s[1]), s[1]), reverse=True)
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], -merged[0][0], count, merged))
        count += 1
    return [s[1] for s in heap[0][3]] if heap else [[] for _ in range(k)]


def greedy(lengths: list[int], k: int, equal: bool) -> list[list[int]]:
    """Each item, in input order, to the lightest part; with ``equal`` a bias makes counts come first."""
    bias = sum(lengths) + 1 if equal else 0
    parts, sums = [[] for _ in range(k)], [0] * k
    for i, n in enumerate(lengths):
        at = min(range(k), key=sums.__getitem__)
        parts[at].append(i)
        sums[at] += n + bias
    return parts


def micro_batch_count(rows: int, total: int, most: int, least: int = 1, multiple: int = 1) -> int:
    """Parts of at most ``most`` tokens on average, not more than rows, at least ``least``, rounded up to a multiple."""
    n = max(min(rows, -(-total // most)), least)
    return -(-n // multiple) * multiple


def partitioned(df: DataFrame, batch: str, item: str, length: str, count: Callable[[int, int], int], equal: bool = False, method: Callable = largest_differencing) -> DataFrame:
    """batch, item, part, place, position: each batch's items in balanced parts. Parts are ordered by their sum of
    squared lengths, the heaviest first; ``position`` numbers the items in the new order, so that sorting by ``place``,
    the old order, restores it. ``count`` tells the parts of a batch from its rows and total length."""
    types = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(item).reset_index(drop=True)
        lengths = [int(n) for n in rows[length]]
        parts = [sorted(p) for p in method(lengths, count(len(rows), sum(lengths)), equal)]
        if any(not p for p in parts):
            raise ValueError("a part is empty")
        parts.sort(key=lambda p: (-sum(lengths[i] ** 2 for i in p), p))
        flat = [(rows[batch][0], rows[item][i], n, i) for n, p in enumerate(parts) for i in p]
        return pd.DataFrame([(*f, at) for at, f in enumerate(flat)], columns=[batch, item, "part", "place", "position"])

    ship(df.sparkSession)
    return df.select(batch, item, length).groupBy(batch).applyInPandas(run, f"{batch} {types[batch]}, {item} {types[item]}, part int, place int, position int")


def part_sums(parts: DataFrame, df: DataFrame, batch: str, item: str, length: str) -> DataFrame:
    """The total length of each part, and the spread of parts per batch beside that of contiguous ones."""
    return parts.join(df.select(batch, item, length), [batch, item]).groupBy(batch, "part").agg(F.sum(length).alias("total"), F.count("*").alias("items"))
