"""Gathered groups, resumed steps, packed test cases and drawn expressions."""

import base64
import json
import os
import pickle
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.operators.expressions import random_expression
from sievework.sources import blobs
from sievework.streaming import flows
from sievework.streaming.resumable import StepLog, curriculum, resumed_batches


def started(spark, tmp_path, wanted: int, most: int) -> StreamingQuery:
    stream = flows.growing_source(spark, str(tmp_path / "in"), "g long, v int")
    return flows.accumulate_groups(stream, "g", wanted, str(tmp_path / "held"), str(tmp_path / "state"), lambda b: b.where("v > 0"), most)


def test_gathering_fails_after_the_most_batches(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, "g long, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([(1, 1), (2, 0)])
    started(spark, tmp_path, 3, 2).awaitTermination()  # one batch of two: not yet a failure
    write([(3, 1), (3, 2)])
    with pytest.raises(Exception, match="2 of 3 groups after 2 batches"):  # the count goes on after the restart
        started(spark, tmp_path, 3, 2).awaitTermination()
    assert [tuple(r)[:2] for r in flows.accumulated(spark, str(tmp_path / "held"), 2, "g", "v").select("g", "v").collect()] == [(1, 1), (3, 1)]
    started(spark, tmp_path, 2, 2).awaitTermination()


def test_steps_are_committed_once(spark, tmp_path):
    log = StepLog(spark, str(tmp_path))
    rows = spark.range(10).withColumnRenamed("id", "row_id")
    assert log.latest() == -1
    for step, some in resumed_batches(rows, 3, log):
        if step == 2:
            some.limit(1).write.parquet(log.folder(step))  # a stop between the rows and their marker
            break
        log.commit(step, some)
    assert log.latest() == 1 and log.read_all().count() == 6
    again = StepLog(spark, str(tmp_path))
    for step, some in resumed_batches(rows, 3, again):
        again.commit(step, some)
    assert sorted((r["step"], r["row_id"]) for r in again.read_all().collect()) == [(k // 3, k) for k in range(10)]
    assert list(resumed_batches(rows, 3, again)) == [] and list(resumed_batches(rows.limit(0), 3, StepLog(spark, f"{tmp_path}/none"))) == []


def test_curriculum_equals_a_sequential_one(spark, tmp_path):
    weights = {k: float(k * 7 % 11) for k in range(20)}
    df = spark.createDataFrame(list(weights.items()), "k long, w double")
    update = lambda w, taken: F.when(taken, w / 2).otherwise(w + 0.25)
    got = sorted(tuple(r) for r in curriculum(df, "k", F.col("w"), 6, 4, str(tmp_path), update).select("step", "k", "weight").collect())
    want = []
    for step in range(4):
        chosen = sorted(weights, key=lambda k: (-weights[k], k))[:6]
        want += [(step, k, weights[k]) for k in chosen]
        weights = {k: w / 2 if k in chosen else w + 0.25 for k, w in weights.items()}
    assert got == sorted(want)


class Trap:
    def __reduce__(self):
        return os.mkdir, ("/tmp/never-made",)


def test_blobs():
    wrap = lambda b: base64.b64encode(zlib.compress(b)).decode()
    text = json.dumps([{"input": "é\n" * 1000, "output": "\U0001f600"}])
    for protocol in range(6):
        assert blobs.unpacked(wrap(pickle.dumps(text, protocol))) == text
    assert blobs.unpacked(blobs.packed(text)) == text == blobs.unpacked(text) and blobs.unpacked(None) is None
    for bad in (Trap(), [text], b"bytes", 5, (text, text), {"a": text}):
        assert blobs.unpacked(wrap(pickle.dumps(bad))) is None
    assert not os.path.exists("/tmp/never-made")
    assert blobs.unpacked("not base64!") is None and blobs.unpacked(base64.b64encode(b"x").decode()) is None and blobs.unpacked(wrap(b"")) is None
    bomb = wrap(pickle.dumps("0" * 50_000_000))
    assert blobs.unpacked(bomb, 1 << 20) is None and len(blobs.unpacked(bomb)) == 50_000_000
    assert blobs.inflated(zlib.compress(b"abc")[:-2]) is None


def test_expressions_have_their_value(spark):
    rows = spark.range(300)
    got = rows.select(random_expression(F.col("id"), "@+-", depth=2).alias("e")).select("e.*").collect()

    class N(int):
        """Numbers whose three operators bind alike, from the left: * stands for @, / for + and % for -."""

        __mul__ = lambda a, b: N(3 * int(a) - 2 * int(b))
        __truediv__ = lambda a, b: N(int(a) + int(b))
        __mod__ = lambda a, b: N(int(a) - int(b))

    for r in got:
        code = re.sub(r"\d+", lambda m: f"N({m[0]})", r["text"].replace("@", "*").replace("+", "/").replace("-", "%"))
        assert int(eval(code, {"N": N})) == r["value"], r["text"]  # noqa: S307  drawn above
    assert len({r["text"] for r in got}) > 250 and any("((" in r["text"] or "(" in r["text"] for r in got)
    assert got == rows.repartition(3).orderBy("id").select(random_expression(F.col("id"), "@+-", depth=2).alias("e")).select("e.*").collect()
    with pytest.raises(ValueError):
        random_expression(F.col("id"), "*")
