"""Queries: advantages, returns, masks, losses and pairs over rollout stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import arrays as A
from sievework.operators import advantages as W
from sievework.operators import losses as L
from sievework.plans.standins import SCORED, TOKENS, scored, sequences, table, tokens

QUERIES, ORACLE_SQL = {}, {}
R6 = lambda c, name: F.round(c, 6).alias(name)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_W = "OVER (PARTITION BY uid)"


@query(f"WITH {SCORED} SELECT doc_id, round(CASE WHEN count(*) {_W} = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) {_W}) / (stddev_samp(score) {_W} + 1e-6) END, 6) AS advantage FROM s")
def w1_grpo(spark: SparkSession, sf: str) -> DataFrame:
    return W.grpo(scored(spark, sf)).select("doc_id", R6(F.col("advantage"), "advantage"))


@query(f"""WITH {SCORED}, a AS (SELECT doc_id, uid, CASE WHEN score <> 1 THEN -1.0 ELSE score END AS every, CASE WHEN max(score) {_W} >= 1 AND score <> 1 THEN -1.0 ELSE score END AS solved FROM s)
SELECT doc_id, every::DOUBLE AS every, solved::DOUBLE AS solved FROM a""")
def w2_dynamic_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Both readings: all groups, and groups with a 1."""
    rows = scored(spark, sf).withColumn("every", F.col("score")).withColumn("solved", F.col("score"))
    return W.dynamic_rewards(W.dynamic_rewards(rows, score="every"), True, score="solved").select("doc_id", "every", "solved")


@query(f"""WITH {SCORED} SELECT doc_id, round(CASE WHEN row_number() OVER (PARTITION BY uid ORDER BY score DESC, doc_id) = 1
  THEN (score - lead(score) OVER (PARTITION BY uid ORDER BY score DESC, doc_id)) / (stddev_samp(score) {_W} + 1e-6) ELSE 0 END, 6) AS advantage FROM s""")
def w3_grpo_passk(spark: SparkSession, sf: str) -> DataFrame:
    return W.grpo_passk(scored(spark, sf), "doc_id").select("doc_id", R6(F.col("advantage"), "advantage"))


@query(f"WITH {SCORED}, a AS (SELECT doc_id, score - CASE WHEN count(*) {_W} = 1 THEN 0 ELSE avg(score) {_W} END AS c FROM s) SELECT doc_id, round((c - avg(c) OVER ()) / sqrt(var_samp(c) OVER () + 1e-8), 5) AS advantage FROM a")
def w4_reinforce_baseline(spark: SparkSession, sf: str) -> DataFrame:
    rows = W.centred(scored(spark, sf)).withColumn("mask", F.lit(1.0))
    return W.whitened(rows, "advantage", "mask").select("doc_id", F.round("white", 5).alias("advantage"))


@query(f"WITH {SCORED} SELECT doc_id, round(CASE WHEN count(*) {_W} > 1 THEN (score - avg(score) {_W}) * count(*) {_W} / (count(*) {_W} - 1) ELSE score END, 6) AS advantage FROM s")
def w5_rloo(spark: SparkSession, sf: str) -> DataFrame:
    return W.rloo(scored(spark, sf)).select("doc_id", R6(F.col("advantage"), "advantage"))


@query(f"WITH {SCORED} SELECT doc_id, round(score - CASE WHEN count(*) {_W} > 1 THEN sum(score * len) {_W} / sum(len) {_W} ELSE 0 END, 6) AS advantage FROM s")
def w6_opo(spark: SparkSession, sf: str) -> DataFrame:
    return W.opo(scored(spark, sf), "len").select("doc_id", R6(F.col("advantage"), "advantage"))


@query(f"WITH {SCORED} SELECT doc_id, round(count(*) OVER () / greatest(1, count(*) FILTER (score <> 0) OVER ()) * (score - CASE WHEN count(*) {_W} = 1 THEN 0 ELSE avg(score) {_W} END) / 2.0, 6) AS advantage FROM s")
def w7_gpg(spark: SparkSession, sf: str) -> DataFrame:
    return W.gpg(scored(spark, sf), 2.0).select("doc_id", R6(F.col("advantage"), "advantage"))


@query(f"""WITH RECURSIVE {TOKENS}, n AS (SELECT uid, max(t) AS last FROM k GROUP BY uid),
g AS (SELECT k.uid, k.t, (k.reward - k.value) * k.mask AS adv, k.value * k.mask AS nxt FROM k JOIN n ON k.uid = n.uid AND k.t = n.last
  UNION ALL SELECT k.uid, k.t, (k.reward + 0.9 * g.nxt - k.value + 0.9 * 0.8 * g.adv) * k.mask + (1 - k.mask) * g.adv, k.value * k.mask + (1 - k.mask) * g.nxt FROM g JOIN k ON k.uid = g.uid AND k.t = g.t - 1),
j AS (SELECT uid, t, adv, value, mask FROM g JOIN k USING (uid, t)),
m AS (SELECT sum(adv * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM j),
v AS (SELECT sum((adv - mean) * (adv - mean) * mask) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM j, m)
SELECT uid, t, round((adv - mean) / sqrt(var + 1e-8), 5) AS advantage, round(adv + value, 5) AS return_ FROM j, m, v""")
def w8_gae(spark: SparkSession, sf: str) -> DataFrame:
    return W.gae(sequences(spark, sf), 0.9, 0.8).select("uid", F.col("t").cast("bigint").alias("t"), F.round("advantage", 5).alias("advantage"), F.round("return_", 5).alias("return_"))


@query(f"""WITH RECURSIVE {TOKENS}, n AS (SELECT uid, max(t) AS last FROM k GROUP BY uid),
g AS (SELECT k.uid, k.t, k.reward AS ret, k.reward * k.mask AS carry FROM k JOIN n ON k.uid = n.uid AND k.t = n.last
  UNION ALL SELECT k.uid, k.t, k.reward + 0.93 * g.carry, (k.reward + 0.93 * g.carry) * k.mask FROM g JOIN k ON k.uid = g.uid AND k.t = g.t - 1),
j AS (SELECT uid, t, ret, mask FROM g JOIN k USING (uid, t)),
m AS (SELECT sum(ret * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM j),
v AS (SELECT sum((ret - mean) * (ret - mean) * mask) / (max(n) + 1e-8) * max(n) / (max(n) - 1) AS var FROM j, m)
SELECT uid, t, round(ret, 5) AS return_, round((ret - mean) / sqrt(var + 1e-8) * mask, 5) AS advantage FROM j, m, v""")
def w9_reinforce_plus_plus(spark: SparkSession, sf: str) -> DataFrame:
    return W.reinforce_plus_plus(sequences(spark, sf), 0.93).select("uid", F.col("t").cast("bigint").alias("t"), F.round("return_", 5).alias("return_"), F.round("advantage", 5).alias("advantage"))


@query(f"WITH {TOKENS}, r AS (SELECT *, sum(reward * mask) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ret FROM k) SELECT uid, t, round(ret, 5) AS return_, round((ret - 0.5) * mask, 5) AS advantage FROM r")
def w10_remax(spark: SparkSession, sf: str) -> DataFrame:
    return W.remax(tokens(spark, sf), F.lit(0.5)).select("uid", F.col("t").cast("bigint").alias("t"), F.round("return_", 5).alias("return_"), F.round("advantage", 5).alias("advantage"))


@query(f"""WITH {TOKENS}, q AS (SELECT *, count(*) OVER (PARTITION BY t) AS n, (sum(reward) OVER (PARTITION BY t) - reward) AS others FROM k),
a AS (SELECT uid, t, (reward - CASE WHEN n > 1 THEN others / (n - 1) ELSE 0 END) * mask AS c FROM q)
SELECT uid, t, round(sum(c) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 3) AS advantage FROM a""")
def w11_token_rloo(spark: SparkSession, sf: str) -> DataFrame:
    """Token-level leave-one-out over all samples at a position, then the reverse running sum."""
    at = Window.partitionBy("t")
    n, total = F.count("*").over(at), F.sum("reward").over(at)
    base = F.when(n > 1, (total - F.col("reward")) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)
    ahead = Window.partitionBy("uid").orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = tokens(spark, sf).withColumn("c", (F.col("reward") - base) * F.col("mask"))
    return rows.select("uid", F.col("t").cast("bigint").alias("t"), F.round(F.sum("c").over(ahead), 3).alias("advantage"))


@query(f"WITH {SCORED}, b AS (SELECT (ln(sum(exp(0.5 * score))) - ln(count(*))) / 0.5 AS base FROM s) SELECT doc_id, round(score - base, 6) AS advantage FROM s, b")
def w12_softmean(spark: SparkSession, sf: str) -> DataFrame:
    return W.softmean(scored(spark, sf), 0.5).select("doc_id", R6(F.col("advantage"), "advantage"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 2 ORDER BY o_totalprice DESC, o_orderkey) = 1 AS chosen FROM orders")
def w13_onlinedpo_preference(spark: SparkSession, sf: str) -> DataFrame:
    return W.onlinedpo_preference(table(spark, sf, "orders"), "o_totalprice", "o_orderkey").select("o_orderkey", "chosen")


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type = 'purchase' AS stop FROM events)
SELECT user_id, i, CASE WHEN coalesce(sum(stop::INT) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS mask,
  greatest(sum((NOT stop)::INT) OVER (PARTITION BY user_id ORDER BY i) - 1, 0)::BIGINT AS position FROM e""")
def w14_w15_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Response mask up to the first end, and position ids of a mask, as array expressions."""
    ev = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    ids = F.transform("x", lambda e: F.when(e["event_type"] == "purchase", 2).otherwise(5))
    attention = F.transform("x", lambda e: F.when(e["event_type"] == "purchase", 0).otherwise(1))
    rows = ev.select("user_id", A.until_first(ids, [2, 3]).alias("mask"), A.position_ids(attention).alias("position"))
    return rows.select("user_id", F.posexplode(F.arrays_zip("mask", "position")).alias("i", "e")).select("user_id", (F.col("i") + 1).cast("bigint").alias("i"), "e.mask", "e.position")


@query(f"WITH {TOKENS}, l AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY t DESC) AS back FROM k) SELECT uid, count(*) AS n, sum(mask) AS live FROM l WHERE back <= 5 GROUP BY uid")
def w16_response_mask(spark: SparkSession, sf: str) -> DataFrame:
    rows = sequences(spark, sf).select("uid", F.when(F.size("mask") > 5, F.slice("mask", -5, 5)).otherwise(F.col("mask")).alias("m"))
    return rows.select("uid", F.size("m").cast("bigint").alias("n"), F.aggregate("m", F.lit(0.0), lambda a, x: a + x).alias("live"))


@query(f"""WITH {TOKENS}, p AS (SELECT uid, sum((old_logp - ref_logp) * mask) / (sum(mask) + 1e-8) AS kl, sum(reward - 0.1 * (old_logp - ref_logp) * mask) AS total FROM k GROUP BY uid)
SELECT uid, round(total, 5) AS total, round(avg(kl) OVER (), 6) AS current_kl FROM p""")
def w17_kl_penalty(spark: SparkSession, sf: str) -> DataFrame:
    rows, current = W.apply_kl_penalty(tokens(spark, sf), 0.1)
    return rows.groupBy("uid").agg(F.round(F.sum("token_reward"), 5).alias("total")).crossJoin(F.broadcast(current.select(F.round("current_kl", 6).alias("current_kl"))))


@query("""WITH c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM conversations),
s AS (SELECT conv_id, role, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM c) SELECT conv_id, segment::BIGINT AS segment, max(role) AS role, count(*) AS turns FROM s GROUP BY conv_id, segment""")
def w18_turn_segments(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)
    rows = table(spark, sf, "conversations").withColumn("new", new).withColumn("segment", F.sum("new").over(w))
    return rows.groupBy("conv_id", "segment").agg(F.max("role").alias("role"), F.count("*").alias("turns"))


@query("""WITH c AS (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents) SELECT source, count(*) AS kept, max(upto)::BIGINT AS chars FROM c WHERE upto <= 20000 GROUP BY source""")
def w19_char_budget(spark: SparkSession, sf: str) -> DataFrame:
    """References are taken in order until the next would exceed the budget; later ones don't resume."""
    upto = F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf, "documents").withColumn("upto", upto).where("upto <= 20000").groupBy("source").agg(F.count("*").alias("kept"), F.max("upto").alias("chars"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 3")
def w20_examine_cap(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf, "documents").withColumn("n", n).where("n <= 3").select("source", "doc_id")


@query(f"""WITH {TOKENS}, d AS (SELECT *, old_logp - ref_logp AS d FROM k)
SELECT event_id, round(d, 6) AS k1, round(abs(d), 6) AS abs_, round(0.5 * d * d, 6) AS k2, round(least(10, exp(-d) + d - 1), 6) AS k3 FROM d""")
def t1_kl_estimates(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("old_logp"), F.col("ref_logp")
    return tokens(spark, sf).select("event_id", *(R6(W.kl_estimate(a, b, k), n) for k, n in (("k1", "k1"), ("abs", "abs_"), ("k2", "k2"), ("k3", "k3"))))


@query(f"WITH {TOKENS} SELECT event_id, round(reward - (old_logp - ref_logp) * 0.2, 6) AS reward FROM k")
def t2_kl_rewards(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf).select("event_id", R6(L.kl_reward(F.col("reward"), F.col("old_logp"), F.col("ref_logp"), 0.2), "reward"))


_PG = f"""WITH {TOKENS}, x AS (SELECT uid, t, mask, reward - 0.25 AS adv, greatest(-20, least(20, ref_logp - old_logp)) AS d FROM k),
y AS (SELECT *, exp(d) AS r, -adv * exp(d) AS l1, -adv * greatest(0.8, least(1.2, exp(d))) AS l2 FROM x),
z AS (SELECT *, greatest(l1, l2) AS l, CASE WHEN adv < 0 THEN least(-adv * 3.0, greatest(l1, l2)) ELSE greatest(l1, l2) END AS loss FROM y)"""


@query(f"""{_PG} SELECT round(sum(loss * mask) / sum(mask), 6) AS pg_loss, round(sum((l2 > l1)::INT * mask) / sum(mask), 6) AS clipfrac, round(sum(-d * mask) / sum(mask), 6) AS ppo_kl,
  round(sum((l > -adv * 3.0)::INT * (adv < 0)::INT * mask) / sum(mask), 6) AS clipfrac_lower FROM z""")
def t3_policy_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.policy_loss(tokens(spark, sf).withColumn("adv", F.col("reward") - 0.25), "old_logp", "ref_logp", "adv", 0.2, 0.2, 3.0)
    mean = lambda c: L.masked_mean(F.col(c), F.col("mask"))
    return rows.agg(R6(mean("loss"), "pg_loss"), R6(mean("clipped"), "clipfrac"), R6(mean("kl"), "ppo_kl"), R6(mean("clipped_lower"), "clipfrac_lower"))


@query(f"""{_PG}, q AS (SELECT uid, sum(loss * mask) AS s, sum(mask) AS n FROM z GROUP BY uid)
SELECT round(sum(s) / sum(n), 6) AS token_mean, round(avg(s), 6) AS seq_sum, round(avg(s / n), 6) AS seq_mean, round(sum(s) / 100.0, 6) AS seq_norm FROM q WHERE n > 0""")
def a20_loss_aggregation(spark: SparkSession, sf: str) -> DataFrame:
    """Token mean; mean over sequences of token sums or means; sum by the padded width of 100."""
    rows = L.policy_loss(tokens(spark, sf).withColumn("adv", F.col("reward") - 0.25), "old_logp", "ref_logp", "adv", 0.2, 0.2, 3.0)
    live = rows.withColumn("n", F.sum("mask").over(Window.partitionBy("uid"))).where("n > 0")
    modes = (("token-mean", "token_mean"), ("seq-mean-token-sum", "seq_sum"), ("seq-mean-token-mean", "seq_mean"), ("seq-mean-token-sum-norm", "seq_norm"))
    out = None
    for mode, name in modes:
        one = L.aggregate_loss(live, "loss", mode, width=100).select(R6(F.col("loss"), name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


@query(f"""WITH {TOKENS}, s AS (SELECT uid, sum((ref_logp - old_logp) * mask) / sum(mask) AS d FROM k GROUP BY uid HAVING sum(mask) > 0),
x AS (SELECT k.uid, mask, reward - 0.25 AS adv, exp(least(d, 10.0)) AS r FROM k JOIN s USING (uid)),
q AS (SELECT uid, sum(greatest(-adv * r, -adv * greatest(0.9, least(1.1, r))) * mask) / sum(mask) AS l FROM x GROUP BY uid) SELECT round(avg(l), 6) AS loss FROM q""")
def t4_gspo_loss(spark: SparkSession, sf: str) -> DataFrame:
    return L.gspo_loss(tokens(spark, sf).withColumn("adv", F.col("reward") - 0.25), "old_logp", "ref_logp", "adv", 0.1, 0.1).select(R6(F.col("loss"), "loss"))


@query(f"WITH {TOKENS} SELECT round(sum(-ref_logp * (reward - 0.25) * mask) / sum(mask), 6) AS loss FROM k")
def t5_gpg_loss(spark: SparkSession, sf: str) -> DataFrame:
    loss = -F.col("ref_logp") * (F.col("reward") - 0.25)
    return tokens(spark, sf).agg(R6(L.masked_mean(loss, F.col("mask")), "loss"))


@query(f"""WITH {TOKENS}, v AS (SELECT * FROM k WHERE mask = 1), c AS (SELECT *, (reward - avg(reward) OVER ()) * (ref_logp - avg(ref_logp) OVER ()) AS cov, count(*) OVER () AS n FROM v),
o AS (SELECT *, row_number() OVER (ORDER BY cov DESC, event_id) AS i FROM c)
SELECT count(*) AS n, round(sum(cov), 5) AS cov, round(avg(-reward * exp(ref_logp - old_logp) + CASE WHEN i <= greatest(1, floor(n * 0.02)) THEN abs(ref_logp - old_logp) ELSE 0 END), 6) AS loss FROM o""")
def t7_kl_cov_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.kl_cov_loss(tokens(spark, sf).where("mask = 1"), "old_logp", "ref_logp", "reward", 0.02, 1.0, "event_id")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("cov"), 5).alias("cov"), R6(F.avg("loss"), "loss"))


@query(f"""WITH {TOKENS}, x AS (SELECT uid, mask, reward AS adv, least(greatest(ref_logp - old_logp, -0.4), 0.4) AS c, ref_logp - old_logp AS d FROM k),
q AS (SELECT uid, exp(sum((CASE WHEN adv >= 0 THEN least(d, c) ELSE greatest(d, c) END) * mask) / (sum(mask) + 1e-8)) AS r, sum(adv * mask) / (sum(mask) + 1e-8) AS a FROM x GROUP BY uid HAVING sum(mask) > 0)
SELECT round(avg(-a * r), 6) AS loss FROM q""")
def t8_geo_mean_loss(spark: SparkSession, sf: str) -> DataFrame:
    return L.geo_mean_loss(tokens(spark, sf).withColumn("adv", F.col("reward")), "old_logp", "ref_logp", "adv", 0.4, 0.4).select(R6(F.col("loss"), "loss"))


@query(f"""WITH {TOKENS}, x AS (SELECT mask, ref_logp AS v, greatest(value - 0.5, least(value + 0.5, ref_logp)) AS c, reward AS ret FROM k)
SELECT round(0.5 * sum(greatest((v - ret) * (v - ret), (c - ret) * (c - ret)) * mask) / sum(mask), 6) AS loss, round(sum(((c - ret) * (c - ret) > (v - ret) * (v - ret))::INT * mask) / sum(mask), 6) AS clipfrac FROM x""")
def t9_value_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.value_loss(tokens(spark, sf), "ref_logp", "value", "reward", 0.5)
    return rows.agg(R6(0.5 * L.masked_mean(F.col("loss"), F.col("mask")), "loss"), R6(L.masked_mean(F.col("clipped"), F.col("mask")), "clipfrac"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), z AS (SELECT vec_id, x, ln(list_sum(list_transform(x, lambda y: exp(y)))) AS z FROM e)
SELECT vec_id, round(z - list_sum(list_transform(x, lambda y: exp(y - z) * y)), 6) AS entropy, round(x[vec_id % 64 + 1] - z, 6) AS logp FROM z""")
def t10_t11_entropy_and_logprob(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    at = F.get(x, (F.col("vec_id") % 64).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", R6(A.entropy(x), "entropy"), R6(at - A.log_sum_exp(x), "logp"))


@query(f"WITH {TOKENS} SELECT event_id, greatest(least(reward, 1.0), 0.2) AS clipped FROM k")
def t12_clip(spark: SparkSession, sf: str) -> DataFrame:
    return tokens(spark, sf).select("event_id", F.greatest(F.least("reward", F.lit(1.0)), F.lit(0.2)).alias("clipped"))


@query(f"""WITH RECURSIVE {TOKENS}, s AS (SELECT t, avg(abs(old_logp - ref_logp)) AS kl, count(*) AS n FROM k GROUP BY t),
c AS (SELECT 0::BIGINT AS t, 0.2 * (1 + greatest(-0.2, least(0.2, kl / 0.3 - 1)) * n / 1000.0) AS beta FROM s WHERE t = 0
  UNION ALL SELECT s.t, c.beta * (1 + greatest(-0.2, least(0.2, s.kl / 0.3 - 1)) * s.n / 1000.0) FROM c JOIN s ON s.t = c.t + 1) SELECT t, round(beta, 6) AS beta FROM c""")
def t13_adaptive_kl(spark: SparkSession, sf: str) -> DataFrame:
    """The coefficient after each step: a running product, as each step's factor doesn't depend on the last."""
    steps = tokens(spark, sf).groupBy("t").agg(F.avg(F.abs(F.col("old_logp") - F.col("ref_logp"))).alias("kl"), F.count("*").alias("n"))
    return L.adaptive_kl(steps, "t", "kl", "n", 0.2, 0.3, 1000).select(F.col("t").cast("bigint").alias("t"), R6(F.col("beta"), "beta"))


_PAIRS = "p AS (SELECT o_orderkey // 2 AS pair, max(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) / 1e5 AS a, max(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) / 1e5 AS b FROM orders GROUP BY 1 HAVING count(*) = 2)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda k: F.max(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice"))) / 1e5
    return table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 2).alias("pair")).agg(side(0).alias("a"), side(1).alias("b"), F.count("*").alias("n")).where("n = 2").drop("n")


@query(f"WITH {_PAIRS} SELECT pair, round(ln(1 + exp(-0.5 * (a - b))) * 0.9 + ln(1 + exp(0.5 * (a - b))) * 0.1, 6) AS sigmoid, round((a - b - 1) * (a - b - 1), 6) AS ipo, round((a - 0.5 * b) * (a - 0.5 * b), 6) AS sppo FROM p")
def t14_t16_preference_losses(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("a") - F.col("b")
    return _pairs(spark, sf).select("pair", R6(L.dpo_loss(d, 0.5, "sigmoid", 0.1), "sigmoid"), R6(L.dpo_loss(d, 0.5, "ipo"), "ipo"), R6(L.sppo_loss(F.col("a"), F.col("b"), 0.5), "sppo"))


@query(f"WITH {TOKENS} SELECT uid, round(sum(CASE WHEN mask = 1 THEN ref_logp ELSE 0 END), 5) AS total, round(sum(CASE WHEN mask = 1 THEN ref_logp ELSE 0 END) / sum(mask), 6) AS mean FROM k GROUP BY uid HAVING sum(mask) > 0")
def t15_batch_logps(spark: SparkSession, sf: str) -> DataFrame:
    """Label log-probabilities summed or averaged over labels that aren't ignored."""
    kept = F.sum(F.when(F.col("mask") == 1, F.col("ref_logp")).otherwise(0.0))
    return tokens(spark, sf).groupBy("uid").agg(F.round(kept, 5).alias("total"), F.sum("mask").alias("n"), kept.alias("s")).where("n > 0").select("uid", "total", R6(F.col("s") / F.col("n"), "mean"))


@query(f"""WITH {SCORED}, x AS (SELECT CASE WHEN score = 1 THEN -0.01 ELSE 0.01 END::DOUBLE * len AS x FROM s)
SELECT round(avg(least(100, greatest(x, 0) + ln(1 + exp(-abs(x))))), 6) AS loss FROM x""")
def t17_ce_reward_loss(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).agg(R6(F.avg(L.ce_reward_loss(F.col("len") * 1.0, F.col("score") == 1, 0.01)), "loss"))


@query(f"WITH {SCORED} SELECT round(sum(6.0 * 7000000 * len + 12.0 * 64 * 128 * 28 * len * len) / 1e12, 4) AS tflops FROM s")
def t18_flops(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).agg(F.round(F.sum(L.dense_flops(F.col("len").cast("double"), 7_000_000, 64, 128, 28)) / 1e12, 4).alias("tflops"))
