"""Near-duplicate groups by circulant MinHash.

One permutation places each shingle in a universe of UNIVERSE positions; a second permutation, shifted circularly by k,
gives coordinate k of the signature (C-MinHash). A shingle's values for all coordinates lie side by side in the second
permutation, so that a signature is a running minimum over slices of one table. BANDS bands of ROWS coordinates give
bucket keys; two sets of similarity 0.8 miss all of them with a chance of 5 in a million.

Documents with the same set are one class from the start. No list of all pairs of a bucket is made. First every class
is confirmed against the mate of least id with which it shares most bands, which joins most of a group of copies. Then
clusters of classes that buckets connect are looked at: where a cluster still has several components, blocks of its
classes with their signatures and sets are dealt to tasks, and a task confirms likely pairs of different components
until its rows can't be joined further. A pair is passed over only if a chain of links joins it already or its
estimated similarity is below LIKELY. Every link rests on the exact Jaccard similarity of full sets.

Defined cases: a null or blank text has an empty set and is linked with nothing; a text with fewer words than a shingle
is one shingle; rows that repeat a doc_id are one document, linked with whatever one of its texts is linked with; rows
without a doc_id are left as they are, unlinked; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.components import components
from sievework.llm.shared import cut, map_arrow
from sievework.llm.shingles import mixed, shingle_set
from sievework.shipping import ship

UNIVERSE, BANDS, ROWS, SEED = 1 << 21, 40, 6, 20240229
#: Pairs whose signatures agree in less than this share are no links: 4.6 standard errors under 0.8.
LIKELY = 0.68
#: Nodes in a block; two blocks of a cluster are held against each other at once.
BLOCK = 1024
#: Nodes with bucket mates up to which their ids are broadcast to the documents; beyond, both are shuffled.
BROADCAST_NODES = 1_000_000

_table: list[np.ndarray] = []


def circulant() -> np.ndarray:
    """Row p: the values that the shifted second permutation gives position p, for all coordinates."""
    if not _table:
        pi = np.random.Generator(np.random.PCG64(SEED)).permutation(UNIVERSE).astype(np.int32)
        pi = np.concatenate([pi, pi[: BANDS * ROWS]])
        _table.append(np.lib.stride_tricks.sliding_window_view(pi, BANDS * ROWS))
    return _table[0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """All coordinates of a set."""
    rows = circulant()
    places = np.unique((mixed(shingles ^ np.uint64(SEED)) & np.uint64(UNIVERSE - 1)).astype(np.int64))
    out = None
    for at in range(0, len(places), 2048):
        part = rows[places[at : at + 2048]].min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig.reshape(BANDS, ROWS)[:, i].astype(np.uint64))
    return h.view(np.int64)


def summaries(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_id (a 128-bit hash of the set), bands and one byte per coordinate as ``sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingle_set(t or b"", n) for t in batch.column("text").to_pylist()]
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([None if s is None else band_keys(s) for s in sigs], pa.list_(pa.int64())),
                        pa.array([None if s is None else (s ^ (s >> 8) ^ (s >> 16)).astype(np.uint8).tobytes() for s in sigs], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_id", "bands", "sig"],
                )

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_shingles long, set_id binary, bands array<long>, sig binary")


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    same = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return 100 * same >= percent * (len(p) + len(q) - same)


def full_sets(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, shingles (packed) of the sets that ``nodes`` (node, doc, set_id) names: that of a text of the document
    ``doc`` whose set has the hash ``set_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingle_set(t or b"", n).tobytes() for t in batch.column("text").to_pylist()]
                right = [xxhash.xxh3_128_digest(s) == h for s, h in zip(sets, batch.column("set_id").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"]).filter(pa.array(right, pa.bool_()))

    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    named = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text")).join(nodes, "doc").select("node", "set_id", "text")
    return map_arrow(named, run, "node long, shingles binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x"), batch.column("y"))
            keep = [similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair), percent) for pair in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def _confirm_task(table, percent: int):
    """Links that join different components among a task's rows (node, component, side, n, sig, shingles): the likely
    pairs in order of estimated similarity, but those that earlier links have joined already."""
    order = np.argsort(table.column("node").to_numpy(), kind="stable")
    node, comp, n = (table.column(c).to_numpy()[order] for c in ("node", "component", "n"))
    sig = np.stack([np.frombuffer(x, np.uint8) for x in table.column("sig").to_pylist()])[order]
    packed = table.column("shingles").to_pylist()
    least, first, second, same = LIKELY * BANDS * ROWS, [], [], []
    for i in range(len(node) - 1):
        j = i + 1 + np.flatnonzero((comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i])))
        if len(j):
            equal = (sig[j] == sig[i]).sum(axis=1)
            j, equal = j[equal >= least], equal[equal >= least]
            first.append(np.full(len(j), i))
            second.append(j)
            same.append(equal)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    a, b = [], []
    if first:
        first, second, same = map(np.concatenate, (first, second, same))
        for k in np.argsort(-same, kind="stable"):
            i, j = first[k], second[k]
            ri, rj = root(int(comp[i])), root(int(comp[j]))
            if ri != rj and similar(np.frombuffer(packed[order[i]], np.uint64), np.frombuffer(packed[order[j]], np.uint64), percent):
                parent[max(ri, rj)] = min(ri, rj)
                a.append(node[i])
                b.append(node[j])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _tasks(nodes: DataFrame) -> DataFrame:
    """``nodes`` (cluster, node, component, n) of clusters with several components, dealt to tasks: each pair of nodes
    in different components of a cluster meets in one. A component of more than BLOCK nodes is a unit of its own, whose
    blocks are never held against each other; the small ones of a cluster are one unit."""
    sizes = cut(nodes.groupBy("cluster", "component").agg(F.count("*").alias("size")))
    several = sizes.groupBy("cluster").agg(F.count("*").alias("found")).where("found > 1").select("cluster")
    sizes = sizes.join(several, "cluster", "left_semi").withColumn("unit", F.when(F.col("size") > BLOCK, F.col("component")).otherwise(F.lit(-1).cast("long")))
    units = cut(sizes.groupBy("cluster", "unit").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"), F.max("size").alias("largest")))
    # nodes meet their component's row by both keys, so that a hot cluster isn't a task's
    placed = nodes.join(cut(sizes.join(units.select("cluster", "unit", "blocks"), ["cluster", "unit"])), ["cluster", "component"])
    dealt = F.when(F.col("size") > BLOCK, F.xxhash64("node")).otherwise(F.xxhash64("component"))
    placed = placed.withColumn("block", F.pmod(dealt, F.col("blocks")).cast("int"))
    left = units.select("cluster", F.col("unit").alias("ua"), F.col("blocks").alias("na"), F.col("largest").alias("la"))
    right = units.select("cluster", F.col("unit").alias("ub"), F.col("blocks").alias("nb"))
    pairs = left.join(right, "cluster").where((F.col("ua") < F.col("ub")) | ((F.col("ua") == F.col("ub")) & (F.col("la") <= BLOCK)))
    pairs = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = pairs.where((F.col("ua") < F.col("ub")) | (F.col("i") <= F.col("j")))
    sides = F.array_distinct(F.array(F.struct(F.col("ua").alias("unit"), F.col("i").alias("block")), F.struct(F.col("ub").alias("unit"), F.col("j").alias("block"))))
    tasks = pairs.select("cluster", "ua", "i", "ub", "j", F.explode(sides).alias("s")).select("cluster", "ua", "i", "ub", "j", "s.unit", "s.block")
    return placed.join(tasks, ["cluster", "unit", "block"]).select("cluster", "ua", "i", "ub", "j", "node", "component", "n")


def links(docs: DataFrame, classes: DataFrame, n: int, percent: int, known_links: DataFrame | None = None) -> DataFrame:
    """node, component of the classes (node, doc, set_id, n, bands, sig) that are linked; ``known_links`` (a, b) hold
    from the start."""
    spread = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("rows")).where("rows > 1")
    mates = spread.join(shared, "key").where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("bands"))
    mates = cut(mates)
    clusters = cut(components(mates.select(F.col("node").alias("a"), F.col("pivot").alias("b"))))
    roots = clusters.select(F.col("component").alias("node")).distinct()
    nodes = cut(clusters.select("node", F.col("component").alias("cluster")).unionByName(roots.withColumn("cluster", F.col("node"))))
    sets = cut(full_sets(docs, classes.select("node", "doc", "set_id").join(nodes.select("node"), "node", "left_semi"), n))
    best = mates.groupBy("node").agg(F.max_by("pivot", F.struct("bands", -F.col("pivot"))).alias("b")).select(F.col("node").alias("a"), "b")
    found = confirmed(best, sets, percent)
    found = cut(found if known_links is None else found.unionByName(known_links))
    labels = components(found)
    known = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    slim = classes.select("node", "n", "sig")
    tasks = _tasks(cut(known.join(slim.select("node", "n"), "node")))
    rows = tasks.join(slim.select("node", "sig"), "node").join(sets, "node")
    ship(docs.sparkSession)

    def run(table):  # applyInArrow takes a function of a table by its lack of hints
        return _confirm_task(table, percent)

    more = rows.groupBy("cluster", "ua", "i", "ub", "j").applyInArrow(run, "a long, b long")
    return components(cut(found.unionByName(more)))


def _own_nodes(same: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``same`` (set_id, doc, ...) with a node per set, and the links (a, b) between nodes of one document. The node is
    the document's id; of a document with several sets all but one get a hash that is no other node's."""
    several = same.groupBy("doc").agg(F.count("*").alias("sets")).where("sets > 1").select("doc")
    several = cut(same.select("set_id", "doc").join(several, "doc", "left_semi"))
    more = cut(several.join(several.groupBy("doc").agg(F.max("set_id").alias("first")), "doc").where("set_id <> first").select("set_id", "doc"))
    if more.isEmpty():
        return same.withColumn("node", F.col("doc")), None
    salt = 0
    while True:
        named = cut(more.withColumn("own", F.xxhash64("set_id", "doc", F.lit(salt))))
        taken = named.join(same.select(F.col("doc").alias("own")), "own", "left_semi")
        if taken.isEmpty() and named.groupBy("own").count().where("count > 1").isEmpty():
            break
        salt += 1
    nodes = same.join(named.select("set_id", "own"), "set_id", "left").withColumn("node", F.coalesce("own", "doc")).drop("own")
    return cut(nodes), named.select(F.col("own").alias("a"), F.col("doc").alias("b"))


def _representatives(full: DataFrame) -> DataFrame:
    """set_id, doc, n, bands, sig: one of the rows of each set, one of its least document. Sets are grouped by columns of
    fixed width; what is wide stays where it is but for the rows that are picked."""
    doc = F.col("doc_id").cast("long")
    picked = cut(full.select("set_id", doc.alias("doc"), "row").groupBy("set_id").agg(F.min_by("row", "doc").alias("row"))).select("row")
    few = picked.count() <= BROADCAST_NODES
    wide = full.join(F.broadcast(picked) if few else picked, "row", "left_semi")
    wide = wide.select("set_id", doc.alias("doc"), F.col("n_shingles").alias("n"), "bands", "sig")
    return wide if few else cut(wide)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; ``n`` words make a shingle, and documents are linked
    from ``percent`` of similarity on."""
    rows = cut(summaries(docs, n).withColumn("row", F.monotonically_increasing_id()))
    classes, own = _own_nodes(_representatives(rows.where("n_shingles > 0 AND doc_id IS NOT NULL")))
    labels = links(docs, classes, n, percent, own)
    names = classes.select("set_id", "doc", "node").join(labels, "node", "left").select("set_id", "doc", F.coalesce("component", "node").alias("component"))
    if own is not None:  # a component's least node may be a hash
        least = names.groupBy("component").agg(F.min("doc").alias("least"))
        names = names.join(least, "component").select("set_id", F.col("least").alias("component"))
    names = names.select("set_id", "component")
    out = rows.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id")).join(names, "set_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
