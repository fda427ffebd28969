"""Published expectations and cases of our own, as literals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions import arrays as A
from sievework.functions import latex as X
from sievework.functions import text as T
from sievework.operators import advantages as W
from sievework.operators import balance, batch, extensions, filters, losses, metrics, mixtures, pairs, prep, retrieval, rewards
from sievework.sources import io
from sievework.streaming import flows


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("Step 1: a\nStep 2: b\nStep 3: c", 1.0), ("Step 1: a", 1 / 3), ("First, x. Finally, y.", 2 / 3)])
def test_reasoning_steps(spark, text, want):
    assert one(spark, T.reasoning_steps_reward(F.col("s")), s=text) == pytest.approx(want)


@pytest.mark.parametrize("right,length,want", [(True, 22, 0.943), (True, 80, 0.547), (False, 22, -0.942), (False, 80, -0.547)])
def test_cosine(spark, right, length, want):
    assert one(spark, T.cosine_reward(F.lit(right), F.lit(length), 100)) == pytest.approx(want, abs=0.005)


@pytest.mark.parametrize("text,most,want", [("A B C A B C", -1.0, -0.25), ("A B C A B C E F G A B C A B C", -1.0, -0.3846), ("A B C A B", -0.5, 0.0), ("", -1.0, 0.0), ("a b", -1.0, 0.0)])
def test_repetition(spark, text, most, want):
    assert one(spark, T.repetition_penalty(F.col("s"), 3, most), s=text) == pytest.approx(want, abs=1e-3)


def test_repetition_rejects_positive_penalty():
    with pytest.raises(ValueError):
        T.repetition_penalty(None, 3, 0.5)


@pytest.mark.parametrize("length,want", [(50, 0.0), (90, -0.5), (110, -1.0)])
def test_overlong(spark, length, want):
    assert one(spark, T.soft_overlong(F.lit(length), 100, 20)) == pytest.approx(want)


@pytest.mark.parametrize("text,want", [("<think>\na\n</think>\n<answer>\nb\n</answer>", 1.0), ("<think>a</think><answer>b</answer>", 0.0), ("<think>\na\n</think>", 0.0), ("<answer>\nb\n</answer>", 0.0), ("a", 0.0)])
def test_format(spark, text, want):
    assert one(spark, T.format_reward(F.col("s")), s=text) == want


@pytest.mark.parametrize("text,want", [("I don't know.", "i dont know"), ("The  Cat, a dog!", "cat dog"), ("été a", "été")])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize_answer(F.col("s")), s=text) == want


@pytest.mark.parametrize("text,want", [("\\boxed{a{b}c} \\boxed{d}", "a{b"), ("\\boxed{}", ""), ("none", None), ("<answer> x </answer>", "x")])
def test_boxed(spark, text, want):
    assert one(spark, T.boxed_or_tagged(F.col("s")), s=text) == want


def test_masked_mean(spark):
    for values, mask, want in (([1.0, 2.0, 3.0, 4.0], [1, 0, 0, 1], 2.5), ([1.0, 2.0, math.nan, 4.0], [1, 0, 0, 1], 2.5), ([1.0, 2.0, math.nan, 4.0], [1, 0, 1, 0], math.nan)):
        df = spark.createDataFrame(list(zip(values, mask)), "v double, m int")
        got = df.agg(losses.masked_mean(F.col("v"), F.col("m")).alias("x")).first()["x"]
        assert got == pytest.approx(want, nan_ok=True)


def test_gae(spark):
    df = spark.createDataFrame([([0.0, 0.1, 1.0], [1.0, 2.0, 3.0], [1.0, 1.0, 1.0])], "r array<double>, v array<double>, m array<double>")
    got = df.select(A.generalized_advantage(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.95).alias("x")).first()["x"]
    assert got == pytest.approx([0.02195, -0.91, -2.0])


def test_gae_ignores_values_outside_the_mask(spark):
    mask = [0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0]
    reward = [0.0, 0.0, 0.1, 0.1, 0.1, 0.0, 0.0, 0.1, 1.0, 0.0, 0.0]
    results = []
    for seed in (1, 2):
        v = np.random.default_rng(seed).normal(size=11)
        v[[2, 3, 4, 7, 8]] = [4, 5, 6, 7, 9]
        df = spark.createDataFrame([(1, list(range(11)), reward, [float(x) for x in v], mask)], "uid long, t array<int>, reward array<double>, value array<double>, mask array<double>")
        rows = W.gae(df, 0.9, 0.95).orderBy("t").collect()
        results.append([round(r["advantage"], 9) for r in rows if mask[r["t"]]])
    assert results[0] == results[1]


def test_group_advantages(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 3), ("a", 2, -1.0, 1), ("a", 3, 0.0, 2), ("b", 4, 1.0, 5)], "uid string, i int, score double, len int")
    pick = lambda out: [r["advantage"] for r in out.orderBy("i").collect()]
    assert pick(W.grpo(df)) == pytest.approx([0.999999, -0.999999, 0, 0.999999])
    assert pick(W.rloo(df)) == pytest.approx([1.5, -1.5, 0, 1.0]) and sum(pick(W.rloo(df))[:3]) == pytest.approx(0)
    assert pick(W.opo(df, "len")) == pytest.approx([1 - 1 / 3, -1 - 1 / 3, -1 / 3, 1.0])
    assert pick(W.grpo_passk(df, "i", by_std=False)) == [1.0, 0.0, 0.0, None]
    assert pick(W.softmean(df, 0)) == pytest.approx([0.75, -1.25, -0.25, 0.75])


def test_clip_cov_and_registries(spark):
    df = spark.createDataFrame([(i, -0.1 * i, -0.2, float(i % 3)) for i in range(50)], "i long, new double, old double, adv double")
    out = losses.clip_cov_loss(df, "old", "new", "adv", -10.0, 10.0, 1.0, 1, "i")
    assert out.agg(F.sum(F.abs("loss"))).first()[0] == 0
    reg = extensions.Registry("loss")
    f = reg.register("a")(len)
    assert reg.get("a") is f and reg.register("a")(len) is len
    for bad in (lambda: reg.register("a")(max), lambda: reg.get("A")):
        with pytest.raises(ValueError):
            bad()


def test_load_function(tmp_path):
    (tmp_path / "f.py").write_text("def score(x, k): return x * k\n")
    assert extensions.load_function(str(tmp_path / "f.py"), "score", k=3)(2) == 6
    with pytest.raises(AttributeError):
        extensions.load_function(str(tmp_path / "f.py"), "other")


def test_majority(spark):
    rows = [("g", i, p, v) for i, (p, v) in enumerate([("A", 0.9), ("B", 0.8), ("A", 0.7)])] + [("t", i, p, v) for i, (p, v) in enumerate([("A", 0.9), ("B", 0.8), ("B", 0.7), ("A", 0.6)])]
    got = metrics.majority(spark.createDataFrame(rows, "g string, i int, p string, v double"), ["g"], "p", "v", "i").collect()
    assert {r["g"]: r["majority"] for r in got} == {"g": 0.9, "t": 0.9}


def test_bootstrap_is_near_its_closed_form(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 6)], "g string, v double")
    r = metrics.bootstrap(df, ["g"], "v", "v", 3, {"mean": F.avg, "max": F.max}).first()
    best = metrics.expected_best(df, ["g"], "v", 3).first()["expected"]
    assert abs(r["mean_mean"] - 3) < 0.3 and 3.5 < r["max_mean"] < 5 and r["max_mean"] == pytest.approx(best, abs=0.1)


def test_validation_metrics(spark):
    df = spark.createDataFrame([("s1", "p1", 0.8), ("s1", "p1", 0.9), ("s2", "p2", 0.7)], "s string, p string, v double")
    assert {r["s"]: round(r["mean"], 6) for r in metrics.validation(df, "s", "p", "v").collect()} == {"s1": 0.85, "s2": 0.7}


def test_console_line(spark):
    assert one(spark, metrics.from_console(F.col("s"), "critic/rewards/mean"), s="step:3 - a:1.0 - critic/rewards/mean:0.25") == 0.25
    assert one(spark, metrics.from_console(F.col("s"), "critic/rewards/mean"), s="step:3 - a:1.0") == -math.inf


def labels(df):
    return [r["labels"] for r in df.orderBy("row_id").collect()]


def test_batch_verbs(spark):
    rows = batch.with_row_id(spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "id int, labels string"), "id")
    padded, n = batch.pad_to_divisor(rows, 2)
    assert labels(padded) == ["a", "b", "c", "a"] and n == 1 and labels(batch.unpad(padded, n)) == ["a", "b", "c"]
    assert labels(batch.pad_with_last(rows, 2)) == ["a", "b", "c", "c", "c"]
    two = batch.repeated(rows, F.lit(2))
    assert [r["labels"] for r in two.orderBy("row_id", "copy").collect()] == list("aabbcc") and [r["labels"] for r in two.orderBy("copy", "row_id").collect()] == list("abcabc")
    each = batch.repeated(rows, F.element_at(F.array(*map(F.lit, (3, 1, 2))), F.col("id") + 1))
    assert [r["labels"] for r in each.orderBy("row_id").collect()] == list("aaabcc")
    with pytest.raises(ValueError):
        batch.chunks(rows, 2)
    with pytest.raises(ValueError):
        batch.mini_batches(rows, 2, 1)
    assert labels(batch.sliced(rows, 0, 3, 2)) == ["a", "c"]


def test_column_union(spark):
    a = spark.createDataFrame([(1, math.nan), (2, None)], "id int, x double")
    assert batch.column_union(a, a.withColumn("y", F.lit(1)), "id").count() == 2
    with pytest.raises(Exception, match="x differs"):
        batch.column_union(a, a.withColumn("x", F.lit(3.0)), "id").collect()


def test_missing_lookup_is_an_error(spark):
    rows = spark.createDataFrame([(1, [1, 9])], "q int, ids array<int>")
    with pytest.raises(Exception, match="no item 9"):
        batch.lookup_lists(rows, "q", "ids", spark.createDataFrame([(1, "x")], "id int, v string"), "id", "v", "out").collect()


def test_contamination(spark):
    evals = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "zero ONE two  three four five six seven eight nine"), (2, "one two three four five six seven"), (3, "x one two three four five six seven y"), (4, "")], "doc_id int, text string")
    got = {r["doc_id"]: r["bad"] for r in filters.flag_contaminated(docs, "doc_id", "text", {"bad": evals}).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    other = spark.createDataFrame([(7, "x one two three four five six seven"), (8, None), (9, "one two three four five six seven eight")], "item_id int, text string")
    both = filters.flag_contaminated(docs, "doc_id", "text", {"bad": evals, "worse": other, "none": evals.limit(0)})
    assert sorted(map(tuple, both.select("doc_id", "bad", "worse", "none").collect())) == [
        (1, True, True, False), (2, False, False, False), (3, False, True, False), (4, False, False, False)]
    assert filters.flag_contaminated(docs, "doc_id", "text", {}).columns == docs.columns


def test_flags_past_the_broadcast_limit(spark, monkeypatch):
    evals = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, None)], "doc_id int, text string")
    monkeypatch.setattr(filters, "BROADCAST_GRAMS", 0)
    assert sorted(map(tuple, filters.flag_contaminated(docs, "doc_id", "text", {"bad": evals}).select("doc_id", "bad").collect())) == [(1, True), (2, False)]


def test_guided_rows(spark):
    df = spark.createDataFrame([(5, "How many?", "3 and 4\n#### 1,007")], "i int, q string, a string")
    row = prep.guided_rows(df, "s", "q", "a", "i", "Think.", "Be right.", tools=("check", "again"), interaction="checks").first().asDict(True)
    assert row["prompt"] == [{"role": "system", "content": "Be right."}, {"role": "user", "content": "How many? Think."}]
    assert row["extra_info"]["tools_kwargs"] == {t: {"create_kwargs": {"ground_truth": "1007"}} for t in ("check", "again")}
    assert row["extra_info"]["interaction_kwargs"] == {"name": "checks", "query": "How many? Think.", "ground_truth": "1007"}
    bare = prep.guided_rows(df, "s", "q", "a", "i", "Think.").first().asDict(True)
    assert len(bare["prompt"]) == 1 and set(bare["extra_info"]) == {"split", "index", "answer", "question"}
    with pytest.raises(Exception, match="no solution"):
        prep.guided_rows(df.withColumn("a", F.lit("none")), "s", "q", "a", "i", "Think.").collect()


def test_pass_rate_bounds_are_strict(spark):
    df = spark.createDataFrame([(1, [0.0, 0.2]), (2, [0.5, None]), (3, [0.9]), (4, [])], "id int, r array<double>")
    assert [r["id"] for r in filters.pass_rate(df, "r", 0.1, 0.9).collect()] == [2]


def test_out_of_knowledge(spark):
    df = spark.createDataFrame([(1, [(-1,), (-1,)]), (2, [(-1,), (1,)]), (3, [])], "id int, j array<struct<score:int>>")
    assert sorted(r["id"] for r in filters.out_of_knowledge(df, "j").collect()) == [1, 3]


def test_pairs(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], [0.0, 1.0, 1.0]), (2, ["a", "b"], [1.0, 1.0]), (3, ["aaa", "b", "c"], [2.0, 1.0, 0.0])], "p int, s array<string>, r array<double>")
    pick = lambda how, **k: [(r["p"], r["chosen"], r["rejected"]) for r in pairs.choose(df, "p", "s", "r", how, **k).orderBy("p").collect()]
    assert pick("max_min") == [(1, "b", "a"), (3, "aaa", "c")] and pick("max_random") == [(1, "b", "a"), (3, "aaa", "b")]
    assert pick("max_max") == [(3, "aaa", "b")] and pick("random") == [(1, "b", "a"), (3, "aaa", "b")]
    assert pick("max_min_p", penalty=0.1) == [(1, "b", "a"), (3, "aaa", "c")]


def test_mixture(spark):
    a, b = spark.range(20).withColumn("x", F.lit(1)), spark.range(20, 30).withColumn("x", F.lit(2))
    assert mixtures.mixture([(a, None), (b, None)], "id").count() == 30 and mixtures.mixture([(a, 0.25), (b, 0.5)], "id").count() == 10
    assert mixtures.mixture([(a, 1.0)], "id", ["id"]).columns == ["id"]
    train, test = mixtures.train_test_split(b, 0.2, 1, "id")
    assert (train.count(), test.count()) == (8, 2)
    for bad in ([(a, None), (b.drop("x"), None)], []):
        with pytest.raises(ValueError):
            mixtures.mixture(bad, "id")


def test_balance():
    rnd = np.random.default_rng(0)
    lengths = [int(x) for x in rnd.integers(1, 100, 40)]
    for equal in (False, True):
        parts = balance.largest_differencing(lengths, 4, equal)
        sums = [sum(lengths[i] for i in p) for p in parts]
        assert sorted(i for p in parts for i in p) == list(range(40)) and max(sums) - min(sums) <= 12
        assert not equal or {len(p) for p in parts} == {10}
    assert balance.greedy([5, 1, 1, 1], 2, False) == [[0], [1, 2, 3]] and balance.micro_batch_count(10, 950, 300, 1, 2) == 4
    with pytest.raises(ValueError):
        balance.largest_differencing([1, 2, 3], 2, True)


@pytest.mark.parametrize("a,b,want", [("\\frac12", "1/2", True), ("0.5", "\\dfrac{1}{2}", True), ("\\sqrt3", "\\sqrt{3}", True), ("x=5", "5", True), ("50\\%", "50", True), ("a", "b", False), ("3 \\text{ cm}", "3", True)])
def test_equivalent(a, b, want):
    assert X.equivalent(a, b) == want


@pytest.mark.parametrize("a,b,want", [("1,000", "1000.00001", True), ("50", "0.5", True), ("(1, 2)", "(1.0,2)", True), ("(1,2)", "[1,2]", False), ("\\frac{3}{4}", "0.75", True), ("-\\frac{1}{2}", "-0.5", True), ("1", "2", False)])
def test_math_equal(a, b, want):
    assert X.math_equal(a, b) == want


def test_boxes():
    assert X.unboxed(X.last_boxed("a \\boxed{1} b \\boxed{x{y}z}")) == "x{y}z" and X.last_boxed("none") is None and X.unboxed(X.last_boxed("$\\boxed 7$ so")) == "7"
    assert X.repeatness(["a"]) == [0] and X.repeatness(["ab" * 50])[0] > 0.2 > X.repeatness(["the quick brown fox jumps"])[0]
    s = "banana"
    suffixes = sorted(s[i:] for i in range(6))
    lcp = sum(next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b))) for a, b in zip(suffixes, suffixes[1:]))
    assert X.repeatness([None, s, ""])[1] == pytest.approx(2 * lcp / 42)


def test_answer_ladder_order(spark):
    df = spark.createDataFrame([("\\boxed{I don't know}", ["I don't know"], False), ("\\boxed{x}", ["y"], True), ("x", ["x"], False), ("\\boxed{The  X!}", ["x"], False)], "r string, g array<string>, ook boolean")
    got = [r["v"] for r in df.select(rewards.ternary_ook(F.col("r"), F.col("g"), F.array(F.lit(0)), F.col("ook")).alias("v")).collect()]
    assert got == [0.0, -1.0, -1.0, 1.0]


def test_prompts(spark):
    refs = F.array(*map(F.lit, ("aaaa", "bbbbbbbb", "c")))
    assert one(spark, prep.budgeted_references(refs, 6)) == "# Reference 1\naaaa\n"
    with pytest.raises(Exception, match="no solution"):
        one(spark, prep.worked_solution(F.lit("none")))


def test_bm25_and_dense(spark):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish"), (3, "green tree")], "id long, t string")
    q = spark.createDataFrame([(1, "blue fish")], "q long, s string")
    ranked = retrieval.bm25_topk(docs, q, 5, "id", "t", "q", "s").orderBy("rank").collect()
    assert [r["id"] for r in ranked] == [2, 1]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = retrieval.dense_topk(v, v.where("vec_id = 1"), 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 2, 3]


def test_dense_topk_of_many_queries(spark, monkeypatch):
    """Broadcast queries and queries dealt in parts find the same, and what brute force finds; odd rows take no part."""
    import random

    draw = random.Random(3)
    data = [(i, [float(draw.randint(-2, 2)) for _ in range(6)]) for i in range(700)]
    odd = [(None, [1.0] * 6), (900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [math.nan] * 6), (904, [math.inf] * 6)]
    v = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").repartition(5)
    vectors = dict(data)
    for k in (3, 800):
        want = set()
        for q in range(0, 700, 7):
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], x)), i) for i, x in data)
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
        for most in (retrieval.TASK_BYTES, 20_000):
            monkeypatch.setattr(retrieval, "TASK_BYTES", most)
            found = retrieval.dense_topk(v, v.where("vec_id % 7 = 0 OR vec_id > 899"), k)
            assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()} == want
        monkeypatch.undo()
    assert retrieval.dense_topk(v, v.limit(0), 3).count() == 0 and retrieval.dense_topk(v.limit(0), v, 3).count() == 0


def test_first_by_hash(spark, monkeypatch):
    import hashlib

    def order(x):
        return hashlib.md5(f"7:{x}".encode()).hexdigest(), x

    df = spark.range(5000).repartition(6)
    ids = sorted(range(5000), key=order)
    for n in (0, 1, 40, 600, 3000, 6000):
        assert sorted(r["id"] for r in mixtures.first_by_hash(df, n, 7, "id").collect()) == sorted(ids[:n])
    # one key of high place holds nearly all rows, so that a limit by expected share leaves too few
    hot = spark.range(5000).select(F.when(F.col("id") < 40, F.col("id")).otherwise(ids[-1]).alias("id"))
    want = sorted([*range(40), *[ids[-1]] * 4960], key=order)[:200]
    assert sorted(r["id"] for r in mixtures.first_by_hash(hot, 200, 7, "id").collect()) == sorted(want)
    monkeypatch.setattr(mixtures, "MOST_IN_A_TASK", 10)
    assert sorted(r["id"] for r in mixtures.first_by_hash(df, 40, 7, "id").collect()) == sorted(ids[:40])


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(("q", "a"), [("user", "x")])], "extra struct<question:string,answer:string>, messages array<struct<role:string,content:string>>")
    assert io.prompts_and_responses(df, ["extra", "question"], ["extra", "answer"]).first() == ("q", "a")
    assert io.conversations(df).columns == ["messages", "tools", "enable_thinking"]
    for step in (2, 10):
        (tmp_path / f"{step}.jsonl").write_text('{"score": %d}\n' % step)
    assert sorted(tuple(r) for r in io.numbered_steps(spark, str(tmp_path), "score int").collect()) == [(2, 2), (10, 10)]
    io.write_step(spark.range(3), str(tmp_path / "out"), 4, {"e": F.lit(1)})
    assert io.jsonl(spark, str(tmp_path / "out")).select("id", "e", "step").count() == 3
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert io.json_array(spark, str(tmp_path / "a.json")).count() == 2


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, s, 0.6, 100) for s in range(3)], "run long, step int, kl double, n int").write.parquet(str(tmp_path / "in"))
    source = flows.growing_source(spark, str(tmp_path / "in"), "run long, step int, kl double, n int", 100)
    beta = flows.drained(flows.adaptive_coefficient(source, 0.2, 0.3, 1000), "beta_rows", "update").first()
    assert beta["steps"] == 3 and beta["beta"] == pytest.approx(0.2 * 1.02**3)
    groups = flows.growing_source(spark, str(tmp_path / "in"), "run long, step int, kl double, n int", 1)
    flows.accumulate_groups(groups, "step", 2, str(tmp_path / "held"), str(tmp_path / "ck"), lambda b: b.where("kl > 0")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "held")).select("step").distinct().count() == 2


def test_resampling_follows_weights(spark):
    df = spark.range(4).withColumn("w", F.col("id").cast("double"))
    rows = mixtures.resampled(df, F.col("w"), 3000, 1, "id").groupBy("id").count().collect()
    share = {r["id"]: r["count"] / 3000 for r in rows}
    assert share.get(0, 0) < 0.01 and share[3] == pytest.approx(0.5, abs=0.05)


def test_matched_and_plain_answers(spark):
    from sievework.functions import matching as M

    replies = [
        ("The answer is 42.", (True, "42.")), ("So the ANSWER: x = 7. Done", (True, "7")), ("no digits here: yes", (False, "yes")),
        ("first \\boxed{1} then \\boxed{\\frac{2}{3}}", (True, "\\frac{2}{3}")), ("broken \\boxed{5", (False, "broken \\boxed{5")), ("12 is the answer", (True, "12")), ("", (False, "")), (None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(replies)], "i int, r string")
    got = {r["i"]: r["m"] and tuple(r["m"]) for r in df.select("i", M.matched_answer(F.col("r")).alias("m")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(replies)}
    answers = [
        ("\\text{Red}", "red"), ("$1,234,567$", "1234567"), ("1,234,567,890", "1,234,567,890"), ("5 centimeters", "5"), ("7\\frac{3}{4}", "7+3/4"), ("3.0", "3"), ("1, 2 and 3", "1, 2 , 3"),
        ("{x}", "x"), ("\\sqrt{\\pi}", "sqrt(pi)"), ("-  2", "-2"), ("2 million", "2 *10^6"), ("90^\\circ", "90"), ("", ""), (None, None),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(answers)], "i int, a string")
    got = {r["i"]: r["p"] for r in df.select("i", M.plain_answer(F.col("a")).alias("p")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(answers)}


def test_pair_agreement_equals_pairs(spark):
    rnd = np.random.default_rng(3)
    rows = [(g, float(rnd.integers(0, 6)) if g else None, float(rnd.integers(0, 4)) / 3) for g in range(4) for _ in range(1 + 20 * g)]
    rows += [(9, 1.0, None), (9, None, 0.5), (9, 2.0, 0.25), (9, 3.0, 0.75)]

    def brute(mine: list) -> float:
        w = ok = 0.0
        for i, (_, s, a) in enumerate(mine):
            for _, t, b in mine[i + 1 :]:
                if a is not None and b is not None and a != b:
                    w += abs(a - b)
                    ok += abs(a - b) * (s is not None and t is not None and np.sign(s - t) == np.sign(a - b))
        return ok / w if w else 0.5

    df = spark.createDataFrame(rows, "g int, s double, a double")
    got = {r["g"]: r["agreement"] for r in metrics.pair_agreement(df, "g", "s", "a").collect()}
    assert got == pytest.approx({g: brute([r for r in rows if r[0] == g]) for g in {r[0] for r in rows}})


def test_pair_agreement_of_a_large_group(spark):
    df = spark.range(1_000_000).select((F.col("id") % 2 * 0).alias("g"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("s"), (F.col("id") * 7919 % 1_000_003 / 1e6).alias("a"))
    assert metrics.pair_agreement(df, "g", "s", "a").first()["agreement"] == pytest.approx(1.0)


def test_bootstrap_of_a_large_group(spark):
    df = spark.range(300_000).select(F.lit("g").alias("g"), (F.col("id") % 1000 / 1000.0).alias("v"), "id")
    r = metrics.bootstrap(df, ["g"], "v", "id", 4, {"mean": F.avg, "max": F.max, "least": F.min}, draws=500).first()
    assert r["mean_mean"] == pytest.approx(0.4995, abs=0.03) and r["max_mean"] == pytest.approx(0.8, abs=0.03) and r["least_mean"] == pytest.approx(0.2, abs=0.03)


def test_repeatness_by_brute_force():
    rnd = np.random.default_rng(11)
    texts = ["".join(rnd.choice(list("abé\U0001f600"), rnd.integers(0, 40))) for _ in range(60)] + [None, "", "x", "aaaa" * 30]

    def brute(t: str | None) -> float:
        n = len(t or "")
        return 1 - 2 * len({t[i:j] for i in range(n) for j in range(i + 1, n + 1)}) / (n * (n + 1)) if n > 1 else 0.0

    assert X.repeatness(texts) == pytest.approx([brute(t) for t in texts])
    assert X.repeatness(["ab" * 100_000])[0] > 0.99


def test_resampled_bins_grow(spark):
    df = spark.range(50_000).withColumn("w", F.when(F.col("id") < 25_000, 3.0).otherwise(1.0))
    rows = mixtures.resampled(df, F.col("w"), 5_000_000, 2, "id").agg(F.count("*").alias("n"), F.count_if(F.col("id") < 25_000).alias("low")).first()
    assert rows["n"] == 5_000_000 and rows["low"] / 5e6 == pytest.approx(0.75, abs=0.002)


def test_cross_entropy_of_long_sequences(spark):
    rows = spark.createDataFrame([(20000.0, True), (20000.0, False), (-20000.0, True), (0.0, True), (1e9, False)], "t double, ok boolean")
    got = [r[0] for r in rows.select(losses.ce_reward_loss(F.col("t"), F.col("ok"), 0.01)).collect()]
    assert got == pytest.approx([0.0, 100.0, 100.0, math.log(2), 100.0])
