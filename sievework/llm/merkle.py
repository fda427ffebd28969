"""Merkle manifest of a dataset: trees of fan FAN, one for each ``lang`` and one over their roots.

Bottom-up, each level joins runs of FAN consecutive nodes to parents and is persisted in the shared folder. Top-down,
each level is joined to its parents: a child prepends its siblings in the run to the proof suffix that its parent has
inherited. Everything is DataFrame work: leaves are numbered in ranges of their order, so that no task holds a whole
group, a run has FAN rows, and a join's key is a parent. Only the root passes through the driver.

A leaf hashes doc_id, source, lang, n_chars and text: ``-`` for a null, else the bytes of the value, ``:`` and the value.

Defined cases: rows that repeat a doc_id are leaves of their own, in order of their digests; a null doc_id comes first,
and is never tampered with; a null lang is a group of its own, before all others; a group of one leaf has that leaf as
its root, and a table of one group that group's root; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.shared import cut, partitions

#: Nodes of a run.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: dict[str, Column]) -> Column:
    """The digest of a document's FIELDS."""

    def told(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(told(fields[c]) for c in FIELDS)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``i``, their place from 0 in their ``group``, and ``n``, the group's rows. Rows are dealt to ranges
    of (group, order) and numbered there; a row number breaks ties, so that equal rows need not share a range."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    key = ["group", *order, "tie"]
    ranges = cut(rows.repartitionByRange(partitions(rows.sparkSession), *key).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("group", "range").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    sizes = sizes.select("group", "range", before, F.sum("rows").over(Window.partitionBy("group")).alias("n"))
    place = F.row_number().over(Window.partitionBy("group", "range").orderBy(*order, "tie")) - 1
    out = ranges.withColumn("place", place).join(sizes, ["group", "range"])
    return out.withColumn("i", (F.col("before") + F.col("place")).cast("long")).drop("range", "place", "before", "tie")


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The levels (group, i, n, h, kids) over ``nodes`` (group, i, n, h), leaves first, each persisted: ``n`` counts the
    group's nodes on the level. A group ends with its only node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        run = F.array_sort(F.collect_list(F.struct("i", "h")))
        runs = out[-1].where("n > 1").groupBy("group", F.expr(f"i DIV {FAN}").alias("parent"), "n").agg(run.alias("run"))
        kids = F.transform("run", lambda x: x["h"])
        above = F.ceil(F.col("n") / FAN).cast("long").alias("n")
        out.append(cut(runs.select("group", F.col("parent").alias("i"), above, F.sha2(F.array_join(kids, ""), 256).alias("h"), kids.alias("kids"))))
    return out


def roots(tree: list[DataFrame]) -> DataFrame:
    """group, h: the only node of each group's last level."""
    out = None
    for level in tree:
        last = level.where("n = 1").select("group", "h")
        out = last if out is None else out.unionByName(last)
    return out


def proofs(tree: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first level of ``tree`` with ``proof``, an array of what stands left and right of the node's run-mate on each
    level up to the top, and what else ``above`` (group, proof, ...) has for the group's root."""
    carried = [c for c in above.columns if c not in ("group", "proof")]
    parents = None
    for k in range(len(tree) - 1, -1, -1):
        nodes = tree[k]
        found = nodes.where("n = 1").join(above, "group")
        if parents is not None:
            met = parents.select("group", F.col("i").alias("parent"), "kids", F.col("proof").alias("suffix"), *carried)
            inner = nodes.where("n > 1").withColumn("parent", F.expr(f"i DIV {FAN}")).join(met.withColumnRenamed("kids", "run"), ["group", "parent"])
            at = (F.col("i") % FAN).cast("int")
            left = F.array_join(F.slice("run", F.lit(1), at), "")
            right = F.array_join(F.slice("run", at + 2, F.size("run")), "")
            own = F.array(F.struct(left.alias("left"), right.alias("right")))
            found = found.unionByName(inner.withColumn("proof", F.concat(own, "suffix")).select(*found.columns))
        parents = cut(found) if k else found
    return parents


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, tampered_leaf, subroot, root and proof of every document. ``tampered_leaf`` is the digest with the
    text in ASCII lower case where ``tampered`` holds, else the leaf."""
    fields = {c: F.col(c) for c in FIELDS}
    leaf = leaf_digest(fields)
    changed = leaf_digest(fields | {"text": lower_ascii(F.col("text"))})
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("group")  # null first, then bytewise
    other = F.when(F.lit(False) if tampered is None else tampered, changed).otherwise(leaf)
    rows = docs.select(group, F.col("doc_id").alias("doc"), leaf.alias("h"), other.alias("tampered_leaf"))
    bottom = cut(numbered(cut(rows), ["doc", "h"]))
    tree = levels(bottom.select("group", "i", "n", "h"))
    subroots = cut(roots(tree).select(F.lit("").alias("group"), F.col("group").alias("name"), "h"))
    top = cut(numbered(subroots, ["name"]))
    crown = levels(top.select("group", "i", "n", "h"))
    root = roots(crown).first()
    none = F.array().cast("array<struct<left: string, right: string>>")
    start = crown[-1].select("group").distinct().withColumn("proof", none)
    named = proofs(crown, start).select("i", "proof").join(top.select("i", "name", F.col("h").alias("subroot")), "i")
    proved = proofs(tree, cut(named.select(F.col("name").alias("group"), "proof", "subroot")))
    out = bottom.select("group", "i", "doc", "tampered_leaf").join(proved.drop("n", "kids"), ["group", "i"])
    return out.select(F.col("doc").alias("doc_id"), F.col("h").alias("leaf"), "tampered_leaf", "subroot", F.lit(root["h"] if root else None).cast("string").alias("root"), "proof")
