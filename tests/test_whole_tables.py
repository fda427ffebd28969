"""Queries take every row and the whole of a text."""

import random

from pyspark.sql import functions as F

from sievework.plans import registry, standins

SF = "/root/testdata/sf0.001"


def test_token_queries_take_every_user(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    far = events.withColumns({"user_id": F.col("user_id") + 1000, "event_id": F.col("event_id") + 1_000_000})
    events.unionByName(far).write.parquet(f"{tmp_path}/events.parquet")
    n, users = events.count(), events.select("user_id").distinct().count()
    assert standins.tokens(spark, str(tmp_path)).count() == 2 * n
    assert standins.sequences(spark, str(tmp_path)).count() == 2 * users
    uids = {r["uid"] for r in registry.QUERIES["w8_gae"](spark, SF).collect()}
    assert {r["uid"] for r in registry.QUERIES["w8_gae"](spark, str(tmp_path)).collect()} == uids | {u + 1000 for u in uids}


def test_repeatness_judges_the_whole_text(spark, tmp_path):
    rnd = random.Random(3)
    noise = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600))
    rows = [(0, noise + "ab" * 2000), (1, "ab" * 250 + noise * 3 + "".join(rnd.choice("abcdefghijklmnop ") for _ in range(9000)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["repeats"] for r in registry.QUERIES["v9_repeatness"](spark, str(tmp_path)).collect()} == {0: True, 1: False}
