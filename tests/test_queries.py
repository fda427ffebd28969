"""Every registered query against its SQL in DuckDB on the smallest tables, and again with other partition counts."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from sievework.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name in registry.ORACLE_SQL:
        relation = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(relation.columns) == columns
        at = [relation.columns.index(c) for c in columns]
        want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
        assert got == want
    else:
        assert got


def test_partition_counts_do_not_matter(spark):
    names = ["w1_grpo", "w8_gae", "k4_max_min_pairs", "k8_mixture", "k12_k14_k24_reorder", "a28_j13_pair_agreement", "f8_k5_filter_and_downsample"]
    run = lambda n: sorted(map(str, registry.QUERIES[n](spark, SF).collect()))
    first = {n: run(n) for n in names}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert {n: run(n) for n in names} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(abs(r["score"] - (r["accuracy"] - r["hallucination"])) < 1e-5 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
