"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variable divided by its quality weight, drawn from a hash of its id; within a source
the smallest keys come first. A source takes complete epochs first, then documents in order of their keys until the
words reach what is left of its target. What the next document would overshoot is filled from later documents that
still fit, in two more passes over the same order.

The order is never sorted as a whole: keys fall into logarithmic bins, and these into finer ones; sums per source tell
first the bin and then the finer bin in which a budget ends, and only the latter's documents are sorted, some four in a
million of a source. A plan is a row per source with its epochs and cut-offs, so that
applying it needs neither a sort nor a join by document.

Defined cases: a null source is a source of its own, the last; a null or blank text has size 0 and is never taken; a
null doc_id draws one key for all such rows; rows that repeat a doc_id share their key and are taken or left together
if their sizes agree; an empty table gives no rows; other columns of the input pass through ``apply_plan``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.shared import cut, words

#: Most times a document may be taken; bins of keys per doubling, and in all; finer bins of each.
MAX_EPOCHS, PER_DOUBLING, BINS, FINER = 3, 64, 4096, 4096
#: Passes that fill a budget.
PASSES = 3
#: Sources up to which the plan is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def quality_weight(text: Column) -> Column:
    """A weight in (0, 1] that falls with the share of digits and markup symbols among a text's characters."""
    odd = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[0-9#*$%&|<>]"))
    return 1.0 / (1.0 + 20.0 * odd / (1.0 + F.coalesce(F.length(text), F.lit(0))))


def cycling_weights(rank: Column) -> Column:
    """Weights 1, 2, 3, 1, ... for sources in order; ``rank`` starts at 0."""
    return (rank % 3 + 1).cast("double")


def keyed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """``docs`` with mix_size, mix_key and mix_bin."""
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    key = -F.log(draw) / quality_weight(F.col("text"))
    place = F.floor(F.log2("mix_key") * PER_DOUBLING * FINER) + BINS * FINER * 5 // 8
    out = docs.withColumns({"mix_size": F.size(words(F.col("text"))).cast("long"), "mix_key": key})
    return out.withColumn("mix_bin", F.greatest(F.lit(0), F.least(F.lit(BINS * FINER - 1), place)).cast("int"))


def targets(sized: DataFrame, weigh: Callable[[Column], Column] = cycling_weights, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source_size, target. The words of all sources are shared by weight; a source stops at ``max_epochs``
    times its size, and the excess goes to the others by weight. Sources sorted by the share at which they stop make
    this a running sum."""
    sizes = sized.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    ranked = sizes.withColumn("weight", weigh(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1))
    most = F.col("source_size") * float(max_epochs)
    order = Window.orderBy(most / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    heavy = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    shared = ranked.withColumn("level", left / heavy).withColumn("stops", F.col("level") * F.col("weight") > most)
    level = F.max(F.when(~F.col("stops"), F.col("level"))).over(whole)
    return shared.select("source", "source_size", F.when(F.col("stops"), most).otherwise(level * F.col("weight")).alias("target"))


def _taken(i: int) -> Column:
    """Whether pass ``i`` takes a row, by the plan's columns alone."""
    here = (F.col("mix_bin") < F.col(f"bin{i}")) | ((F.col("mix_bin") == F.col(f"bin{i}")) & (F.struct("mix_key", "doc_id") <= F.col(f"cut{i}")))
    fits = (F.col("mix_size") > 0) & (F.lit(True) if i == 0 else F.col("mix_size") <= F.col(f"left{i}"))
    return F.coalesce(here, F.col("mix_bin") < F.col(f"bin{i}")) & fits


def _selected(passes: int) -> Column:
    out = F.lit(False)
    for i in range(passes):
        out = out | _taken(i)
    return out


def _join_plan(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    right = plan.withColumnRenamed("source", "plan_source")
    right = F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right
    return rows.join(right, rows["source"].eqNullSafe(right["plan_source"])).drop("plan_source")


def _ends(sums: DataFrame, bin_: str) -> DataFrame:
    """plan_source, end_bin, before: of ``sums`` (source, bin, words, left, before) the bin in which a source's words
    pass what is left, and its words before that bin. ``before`` of the input are the words before its first bin."""
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy(bin_))
    first = F.min(F.struct(F.col(bin_).alias("bin"), (F.col("upto") - F.col("words")).alias("before"))).alias("end")
    passed = sums.withColumn("upto", upto).where("upto > left").groupBy("source").agg(first)
    return passed.select(F.col("source").alias("plan_source"), F.col("end.bin").alias("end_bin"), F.col("end.before").alias("before"))


def _meet(rows: DataFrame, ends: DataFrame, here: Column, n_sources: int) -> DataFrame:
    ends = F.broadcast(ends) if n_sources <= BROADCAST_SOURCES else ends
    return rows.join(ends, rows["source"].eqNullSafe(ends["plan_source"]) & here)


def make_plan(slim: DataFrame, weigh: Callable[[Column], Column] = cycling_weights, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """The plan for ``slim`` (doc_id, source, mix_size, mix_key, mix_bin) and its number of sources."""
    epochs = F.least(F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) + 1e-12), F.lit(max_epochs)).cast("int")
    plan = targets(slim, weigh, max_epochs).withColumn("epochs", epochs)
    left = F.when(F.col("epochs") >= max_epochs, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = cut(plan.withColumn("left0", left))
    n = plan.count()
    for i in range(PASSES):
        rows = _join_plan(slim, plan, n).where(~_selected(i) & (F.col("mix_size") > 0))
        if i:
            rows = rows.where(F.col("mix_size") <= F.col(f"left{i}"))
        rows = rows.withColumn("bin", (F.col("mix_bin") / FINER).cast("int"))
        sums = rows.groupBy("source", "bin").agg(F.sum("mix_size").alias("words"), F.first(f"left{i}").alias("left"))
        wide = _ends(sums.withColumn("before", F.lit(0).cast("long")), "bin")
        inner = _meet(rows, wide, F.col("bin") == F.col("end_bin"), n)
        finer = inner.groupBy("source", "mix_bin").agg(F.sum("mix_size").alias("words"), F.first(f"left{i}").alias("left"), F.first("before").alias("before"))
        ends = cut(_ends(finer, "mix_bin"))
        hot = _meet(rows, ends, F.col("mix_bin") == F.col("end_bin"), n)
        inside = F.col("before") + F.sum("mix_size").over(Window.partitionBy("source").orderBy("mix_key", "doc_id"))
        last = i == PASSES - 1
        within = F.col("inside") <= F.col(f"left{i}") if not last else F.col("inside") - F.col("mix_size") / 2 <= F.col(f"left{i}")
        cuts = hot.withColumn("inside", inside).where(within).groupBy(F.col("plan_source").alias("cut_source")).agg(F.max(F.struct("mix_key", "doc_id")).alias(f"cut{i}"), F.max("inside").alias("inside"))
        # a source whose rows all fit ends behind the last bin
        found = ends.join(cuts, ends["plan_source"].eqNullSafe(cuts["cut_source"]), "left").select(
            "plan_source", F.col("end_bin").alias(f"bin{i}"), f"cut{i}", F.coalesce("inside", "before").alias("used"))
        total = sums.groupBy("source").agg(F.sum("words").alias("all_words")).withColumnRenamed("source", "all_source")
        plan = plan.join(found, plan["source"].eqNullSafe(found["plan_source"]), "left").drop("plan_source")
        plan = plan.join(total, plan["source"].eqNullSafe(total["all_source"]), "left").drop("all_source")
        plan = plan.withColumn(f"left{i + 1}", F.col(f"left{i}") - F.coalesce("used", "all_words", F.lit(0)))
        plan = cut(plan.withColumn(f"bin{i}", F.coalesce(f"bin{i}", F.lit(BINS * FINER))).drop("used", "all_words"))
    return plan, n


def apply_plan(docs: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """``docs`` (with the columns of ``keyed``) with source_size, target and ``copies``, how often a row is taken."""
    joined = _join_plan(docs, plan, n_sources)
    copies = F.when(F.col("mix_size") > 0, F.col("epochs") + _selected(PASSES).cast("int")).otherwise(0)
    return joined.select(*docs.columns, "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, seed: int = 17, weigh: Callable[[Column], Column] = cycling_weights) -> DataFrame:
    """doc_id, source, mix_size, source_size, target and copies of every document."""
    slim = cut(keyed(docs, seed).select("doc_id", "source", "mix_size", "mix_key", "mix_bin"))
    return apply_plan(slim, *make_plan(slim, weigh))


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    rows = keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text"), seed)
    plan, n = make_plan(cut(rows.select("doc_id", "source", "mix_size", "mix_key", "mix_bin")))
    chosen = apply_plan(rows, plan, n).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
