"""Results on tables that are larger than a sample of them, or hold odd values."""

import math
import re

from pyspark.sql import functions as F

from sievework.functions import equality
from sievework.operators import batch, metrics, mixtures, retrieval
from sievework.operators.expressions import random_expression
from sievework.plans import registry
from sievework.sources import blobs


def test_row_ids_are_places_beyond_a_sample(spark):
    df = spark.range(60_000).withColumn("h", F.struct(mixtures.hash_order(3, "id"), "id"))
    rows = batch.with_row_id(df, "h").select("row_id", "id", F.col("h").getField("id"), "h").collect()
    want = sorted(rows, key=lambda r: tuple(r["h"]))
    assert [r["row_id"] for r in want] == list(range(60_000))


def test_row_ids_with_nulls_and_one_value(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("k"))
    rows = sorted((r["row_id"], r["k"]) for r in batch.with_row_id(df, "k").collect())
    assert rows == [(i, None if i < 1000 else int(i >= 2000)) for i in range(3000)]
    assert batch.with_row_id(df.limit(0), "k").count() == 0


def test_bootstrap_picks_within_its_group(spark):
    """Each group holds one value, so that a resample has no other."""
    df = spark.range(60_000).select(F.concat(F.lit("g"), F.col("id") % 20).alias("g"), "id", (F.col("id") % 20).cast("double").alias("s"))
    made = metrics.bootstrap(df, ["g"], "s", "id", 8, {"mean": F.avg}, draws=20).collect()
    assert len(made) == 20 and all(r["mean_mean"] == float(r["g"][1:]) and r["mean_std"] == 0 for r in made)


def test_draws_meet_a_plain_running_sum(spark):
    df = spark.range(60_000).withColumn("w", (F.col("id") % 7).cast("double"))
    got = {r["draw"]: r["id"] for r in mixtures.resampled(df, F.col("w"), 300, 5, "id").collect()}
    rows = df.orderBy("id").collect()
    sums, total = [], 0.0
    for r in rows:
        total += r["w"] + 1e-8
        sums.append(total)
    us = spark.range(300).withColumn("u", metrics.hashed_unit(F.lit(5), F.col("id"))).collect()
    want = {r["id"]: next(i for i, high in enumerate(sums) if r["u"] < high / total) for r in us}
    assert got == want


def test_column_chunks_keep_the_sign_of_zero(spark, tmp_path):
    rows = [(1, [-1e-7, 1e-7, -0.0, 0.5] + [0.25] * 60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    first = next(r["piece"] for r in registry.QUERIES["u9_column_chunks"](spark, str(tmp_path)).collect() if r["chunk"] == 0)
    assert [math.copysign(1, x) for x in first[:4]] == [-1, 1, -1, 1] and first[:4] == [0, 0, 0, 0.5]


def test_nested_keys_keep_the_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang")
    got = registry.QUERIES["s2_nested_keys"](spark, "/root/testdata/sf0.001").select("doc_id", "prompt", "response").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, docs.collect())))


def test_bm25_sums_scores_where_the_documents_are(spark, monkeypatch):
    """Rows of query and document aren't shuffled for their sums, and both ways agree."""
    docs, asked = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "benchmark"))
    find = lambda: retrieval.bm25_topk(docs, asked, 5, "doc_id", "text", "item_id", "text").select("item_id", "rank", "doc_id", F.round("score", 6))
    plan = find()._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(item_id#\d+L?, doc_id#", plan)
    rows = sorted(find().collect())
    monkeypatch.setattr(retrieval, "QUERY_TERMS", 0)
    assert rows and sorted(find().collect()) == rows


def test_shared_answers_are_judged_once(monkeypatch):
    calls = []
    monkeypatch.setattr(equality, "expressions_equal", lambda x, y: not calls.append(x))
    for _ in range(3):
        assert equality.math_equal("q+41q", "42q") and equality.math_equal("q+41" + "q" * 2000, "42")
    assert len(calls) == 4


def test_packing_takes_small_batches(spark):
    blobs._each(blobs.packed, F.col("x"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_a_single_operator_is_not_drawn(spark):
    assert "operator" not in random_expression(F.col("id"))._jc.toString()
