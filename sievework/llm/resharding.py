"""Resharding by minimum-cost flow.

A layout is a folder of Parquet files, a folder ``generation=/shard=/block=`` for each block of a shard, and a manifest
of blocks that is written last and names all that a reader takes. Rows hold their columns in a struct, so that names
can't clash, beside ``at`` (their place in the block), ``size_`` and ``crc_``.

To reshard, the sizes of old shards and the capacities of new ones make a transport problem whose minimum-cost flow,
found from shard totals alone, tells how many bytes each shard sends to each other one; what stays costs nothing, so the
flow moves the fewest bytes. Blocks are laid along the flow by running sums within their shard. A block that lies within
one transfer stays where it is or moves whole; one on the border of transfers is split by rows, largest first, each to
the transfer that lacks most. Only moved and split blocks are written again, into the next generation; the manifest
takes the others over.

Defined cases: a null text has size 1 (no byte, plus 1) and the crc32 of nothing; null and repeated doc_ids are rows
like others, spread over blocks by doc_id, text and input partition; equal texts aren't kept together; a shard may stay
empty where there are fewer rows than shards; an empty table gives no rows; a row larger than a shard's capacity makes
that shard larger; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.shared import cut
from sievework.shipping import ship

#: Bytes of a block, and blocks that a small shard is cut into if it has BLOCK_ROWS rows for each.
BLOCK_BYTES, BLOCKS, BLOCK_ROWS = 64 << 20, 32, 64
#: Blocks up to which a list of them is broadcast; beyond, both sides are shuffled.
BROADCAST_BLOCKS = 100_000
BLOCK = ["generation", "shard", "block"]


def cheapest_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """The flow (old, new) -> units of least cost that sends all of ``supply`` and fills ``demand``, whose sums must be
    equal: shortest augmenting paths under potentials. Works on shards alone; ties are broken by number."""
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    olds, news = len(supply), len(demand)
    left, lack = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    height = [0] * (olds + news)  # potentials: olds, then news
    while any(left):
        far = [float("inf")] * (olds + news)
        came: list[int | None] = [None] * (olds + news)
        heap = [(0, i) for i in range(olds) if left[i]]
        for _, i in heap:
            far[i] = 0
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < olds:
                steps = [(olds + j, cost[u][j]) for j in range(news)]
            else:
                steps = [(i, -cost[i][u - olds]) for i in range(olds) if flow.get((i, u - olds))]
            for v, c in steps:
                new = d + c + height[u] - height[v]
                if new < far[v]:
                    far[v], came[v] = new, u
                    heapq.heappush(heap, (new, v))
        end = min((olds + j for j in range(news) if lack[j]), key=lambda v: (far[v] + height[v], v))
        height = [h + min(f, far[end]) for h, f in zip(height, far)]
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        arcs = list(zip(path[1:], path))  # from each node to the one after it
        most = min([left[path[-1]], lack[end - olds], *(flow[v, u - olds] for u, v in arcs if u >= olds)])
        for u, v in arcs:
            pair, sign = ((u, v - olds), 1) if u < olds else ((v, u - olds), -1)
            flow[pair] = flow.get(pair, 0) + sign * most
        left[path[-1]] -= most
        lack[end - olds] -= most
    return {pair: n for pair, n in flow.items() if n}


def _manifest(spark: SparkSession, path: str, generation: int) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest-{generation}")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """All rows in the layout's folders, those that no manifest names among them."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/data")


def _small(blocks: DataFrame) -> DataFrame:
    return F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks


def _with_slots(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the slot of their first row in their shard."""
    earlier = Window.partitionBy("shard").orderBy("generation", "block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("first_slot", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*BLOCK).agg(F.count("*").alias("rows"), F.sum("size_").alias("bytes"))


def write_layout(docs: DataFrame, path: str, shard: Column, text: str = "text", block_bytes: int = BLOCK_BYTES) -> None:
    """The first generation of a layout: ``docs`` in the shards that the int column ``shard`` tells."""
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(shard.cast("int").alias("shard"), (F.octet_length(value) + 1).cast("long").alias("size_"), F.crc32(value).alias("crc_"), F.struct(*docs.columns).alias("row"))
    sums = rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size_").alias("bytes")).collect()
    parts = {r["shard"]: max(1, min(BLOCKS, r["rows"] // BLOCK_ROWS), -(-r["bytes"] // block_bytes)) for r in sums}
    table = spark.createDataFrame(list(parts.items()), "shard int, blocks long")
    spread = F.pmod(F.xxhash64(F.struct("row.doc_id", "crc_"), F.spark_partition_id()), F.col("blocks"))
    dealt = rows.join(F.broadcast(table), "shard").withColumn("block", F.concat(F.lit("b"), F.col("shard"), F.lit("-"), spread))
    order = Window.partitionBy("shard", "block").orderBy("row.doc_id", "crc_")
    placed = dealt.withColumn("at", (F.row_number().over(order) - 1).cast("long")).drop("blocks").withColumn("generation", F.lit(0))
    placed.write.partitionBy(*BLOCK).option("compression", "zstd").mode("overwrite").parquet(f"{path}/data")
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    _with_slots(_blocks(_files(spark, path))).write.mode("overwrite").parquet(f"{path}/manifest-0")


def equal_parts(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def transfers(blocks: DataFrame, flow: dict[tuple[int, int], int]) -> DataFrame:
    """``blocks`` and, for each transfer that a block takes part in, target and amount: a shard's blocks and its
    transfers, those that stay first, are laid side by side by running sums."""
    ends, rows = {}, []
    for i, j in sorted(flow, key=lambda p: (p[0], p[0] != p[1], p[1])):
        begin = ends.get(i, 0)
        ends[i] = begin + flow[i, j]
        rows.append((i, j, begin, ends[i]))
    spans = F.broadcast(blocks.sparkSession.createDataFrame(rows, "shard int, target int, begin long, stop long"))  # fewer than shards
    high = F.sum("bytes").over(Window.partitionBy("shard").orderBy("block"))
    laid = blocks.withColumn("high", high).withColumn("low", F.col("high") - F.col("bytes"))
    met = laid.join(spans, "shard").where("low < stop AND begin < high")
    return met.withColumn("amount", F.least("high", "stop") - F.greatest("low", "begin")).drop("high", "low", "begin", "stop")


def _split_rows(rows, wanted):
    """The target of each row of a block: rows from the largest on, each to the target that lacks most."""
    import numpy as np
    import pyarrow as pa

    size, at = rows.column("size_").to_numpy(), rows.column("at").to_numpy()
    heap = [(-a, t) for t, a in zip(wanted.column("target").to_pylist(), wanted.column("amount").to_pylist())]
    heapq.heapify(heap)
    target = np.empty(len(size), np.int32)
    for k in np.lexsort((at, -size)):
        lack, t = heap[0]
        target[k] = t
        heapq.heapreplace(heap, (lack + int(size[k]), t))
    return pa.table([*(rows.column(c) for c in (*BLOCK, "at")), pa.array(target)], [*BLOCK, "at", "target"])


def reshard(spark: SparkSession, path: str, shards: int, capacities: list[int] | None = None, cost: list[list[int]] | None = None, generation: int = 1) -> dict[tuple[int, int], int]:
    """Write generation ``generation`` of the layout: ``shards`` shards of equal sizes, or of ``capacities``, which must
    sum to the data's size. Returns the flow. A unit that changes shards costs 1, or what ``cost`` says."""
    old = cut(_manifest(spark, path, generation - 1))
    sizes = {r["shard"]: r["bytes"] for r in old.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    supply = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    demand = capacities or equal_parts(sum(supply), shards)
    flow = cheapest_flow(supply, demand, cost or [[int(i != j) for j in range(shards)] for i in range(len(supply))])
    if not flow:
        old.write.mode("overwrite").parquet(f"{path}/manifest-{generation}")
        return flow
    sent = transfers(old, flow)
    plan = cut(sent.join(sent.groupBy(*BLOCK).agg(F.count("*").alias("targets")), BLOCK))
    same = plan.where("targets = 1 AND target = shard").select(*BLOCK, "rows", "bytes")
    moved = plan.where("targets = 1 AND target <> shard").select(*BLOCK, "target")
    border = plan.where("targets > 1").select(*BLOCK, "target", "amount")
    files = _files(spark, path)
    ship(spark)
    borders = _small(border.select(*BLOCK).distinct())
    slim = files.select(*BLOCK, "at", "size_").join(borders, BLOCK, "left_semi")

    def split(rows, wanted):  # applyInArrow takes a function of tables by its lack of hints
        return _split_rows(rows, wanted)

    dealt = slim.groupBy(*BLOCK).cogroup(border.groupBy(*BLOCK)).applyInArrow(split, "generation int, shard int, block string, at long, target int")
    whole = files.join(_small(moved), BLOCK)
    parts = files.join(borders, BLOCK, "left_semi").join(dealt, [*BLOCK, "at"])
    place = F.row_number().over(Window.partitionBy(*BLOCK, "target").orderBy("at")) - 1
    parts = parts.withColumn("at", place.cast("long"))
    made = whole.unionByName(parts).withColumn("shard", F.col("target")).drop("target")
    made.drop("generation").write.partitionBy("shard", "block").option("compression", "zstd").mode("overwrite").parquet(f"{path}/data/generation={generation}")
    new = _blocks(_files(spark, path).where(F.col("generation") == generation))
    _with_slots(same.unionByName(new)).write.mode("overwrite").parquet(f"{path}/manifest-{generation}")
    return flow


def read_layout(spark: SparkSession, path: str, generation: int = 1) -> DataFrame:
    """shard, slot, size and row of every row of a generation."""
    blocks = _manifest(spark, path, generation).select(*BLOCK, "first_slot")
    rows = _files(spark, path).join(_small(blocks), BLOCK)
    return rows.select("shard", (F.col("first_slot") + F.col("at")).alias("slot"), F.col("size_").alias("size"), "row")
