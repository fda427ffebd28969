"""Group-relative advantages and returns, as window functions and array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import arrays as A

EPSILON = 1e-6


def _group(key: str) -> Window:
    return Window.partitionBy(key)


def grpo(df: DataFrame, by_std: bool = True, key: str = "uid", score: str = "score") -> DataFrame:
    """(s - mean) / (sample deviation + EPSILON) per group; a group of one has mean 0 and deviation 1."""
    w, s = _group(key), F.col(score)
    one = F.count("*").over(w) == 1
    mean = F.when(one, 0.0).otherwise(F.avg(s).over(w))
    std = F.when(one, 1.0).otherwise(F.stddev_samp(s).over(w))
    return df.withColumn("advantage", (s - mean) / (std + EPSILON) if by_std else s - mean)


def dynamic_rewards(df: DataFrame, only_solved: bool = False, key: str = "uid", score: str = "score") -> DataFrame:
    """Every score but 1 becomes -1; with ``only_solved`` just in groups that hold a 1."""
    new = F.when(F.col(score) != 1, -1.0).otherwise(F.col(score))
    if only_solved:
        new = F.when(F.max(score).over(_group(key)) >= 1, new).otherwise(F.col(score))
    return df.withColumn(score, new)


def grpo_passk(df: DataFrame, order: str, key: str = "uid", score: str = "score", by_std: bool = True) -> DataFrame:
    """The first sample of the highest score gets (max - second) / (deviation + EPSILON), all others 0; a group of one
    has no second and gets null."""
    ranked = Window.partitionBy(key).orderBy(F.desc(score), order)
    gap = F.col(score) - F.lead(score).over(ranked)
    gap = gap / (F.stddev_samp(score).over(_group(key)) + EPSILON) if by_std else gap
    return df.withColumn("advantage", F.when(F.row_number().over(ranked) == 1, gap).otherwise(0.0))


def centred(df: DataFrame, key: str = "uid", score: str = "score") -> DataFrame:
    """s - group mean, where a group of one keeps its score."""
    w = _group(key)
    return df.withColumn("advantage", F.col(score) - F.when(F.count("*").over(w) == 1, 0.0).otherwise(F.avg(score).over(w)))


def rloo(df: DataFrame, key: str = "uid", score: str = "score") -> DataFrame:
    """Leave-one-out: (s - mean) n / (n - 1), the raw score in a group of one."""
    w, s = _group(key), F.col(score)
    n = F.count("*").over(w)
    return df.withColumn("advantage", F.when(n > 1, (s - F.avg(s).over(w)) * n / F.greatest(n - 1, F.lit(1))).otherwise(s))


def opo(df: DataFrame, length: str, key: str = "uid", score: str = "score") -> DataFrame:
    """s - length-weighted group mean; a group of one has baseline 0."""
    w = _group(key)
    mean = F.sum(F.col(score) * F.col(length)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.col(score) - F.when(F.count("*").over(w) > 1, mean).otherwise(0.0))


def gpg(df: DataFrame, f_norm: float = 1.0, key: str = "uid", score: str = "score") -> DataFrame:
    """alpha (s - mean) / f_norm with alpha = rows / max(1, rows of nonzero score), over the whole batch."""
    w, s = _group(key), F.col(score)
    totals = df.agg((F.count("*") / F.greatest(F.lit(1), F.count_if(s != 0))).alias("alpha"))
    one = F.count("*").over(w) == 1
    mean = F.when(one, 0.0).otherwise(F.avg(s).over(w))
    return df.withColumn("centred", s - mean).crossJoin(F.broadcast(totals)).withColumn("advantage", F.col("alpha") * F.col("centred") / f_norm).drop("alpha", "centred")


def softmean(df: DataFrame, beta: float, score: str = "score") -> DataFrame:
    """s minus the soft mean of all scores, (log sum exp(beta s) - log n) / beta; the mean for beta 0."""
    if beta == 0:
        base = df.agg(F.avg(score).alias("base"))
    else:
        top = df.agg(F.max(F.col(score) * beta).alias("top"))
        shifted = df.select(score).crossJoin(F.broadcast(top))
        base = shifted.agg(((F.first("top") + F.log(F.sum(F.exp(F.col(score) * beta - F.col("top")))) - F.log(F.count("*").cast("double"))) / beta).alias("base"))
    return df.crossJoin(F.broadcast(base)).withColumn("advantage", F.col(score) - F.col("base")).drop("base")


def whitened(df: DataFrame, value: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """Token values minus the masked mean over all rows, by the root of the unbiased masked variance + 1e-8. The
    statistics are one row, computed in parts and broadcast. A variance of a single token is an error."""
    v, m = F.col(value), F.col(mask)
    sums = df.agg(F.sum(v * m).alias("s"), F.sum(m).alias("n"))
    mean = (F.col("s") / (F.col("n") + 1e-8)).alias("white_mean")
    means = sums.select(mean, F.col("n").alias("white_n"))
    spread = df.crossJoin(F.broadcast(means))
    var = spread.agg((F.sum((v - F.col("white_mean")) ** 2 * m) / (F.first("white_n") + 1e-8)).alias("raw"), F.first("white_n").alias("n"))
    checked = F.when(F.col("n") <= 1, F.raise_error(F.lit("whitening takes two tokens at least")).cast("double")).otherwise(F.col("raw") * F.col("n") / (F.col("n") - 1))
    white = (v - F.col("white_mean")) / F.sqrt(F.col("white_var") + 1e-8)
    white = white if shift_mean else white + F.col("white_mean")
    return spread.crossJoin(F.broadcast(var.select(checked.alias("white_var")))).withColumn("white", white).drop("white_mean", "white_n", "white_var")


def gae(seqs: DataFrame, gamma: float, lam: float) -> DataFrame:
    """Rows uid, t, advantage (whitened), return (before whitening) from arrays reward, value, mask."""
    raw = seqs.withColumn("adv", A.generalized_advantage(F.col("reward"), F.col("value"), F.col("mask"), gamma, lam))
    rows = raw.select("uid", F.explode(F.arrays_zip("t", "adv", "value", "mask")).alias("e")).select("uid", "e.t", "e.adv", "e.value", "e.mask")
    return whitened(rows.withColumn("return_", F.col("adv") + F.col("value")), "adv", "mask").select("uid", "t", F.col("white").alias("advantage"), "return_")


def reinforce_plus_plus(seqs: DataFrame, gamma: float) -> DataFrame:
    """Rows uid, t, return, advantage (whitened and masked)."""
    raw = seqs.withColumn("ret", A.discounted_returns(F.col("reward"), F.col("mask"), gamma))
    rows = raw.select("uid", F.explode(F.arrays_zip("t", "ret", "mask")).alias("e")).select("uid", "e.t", F.col("e.ret").alias("return_"), "e.mask")
    return whitened(rows, "return_", "mask").select("uid", "t", "return_", (F.col("white") * F.col("mask")).alias("advantage"))


def remax(tokens: DataFrame, baseline: Column) -> DataFrame:
    """Masked reverse running sum of rewards, minus the greedy baseline of the sequence."""
    ahead = Window.partitionBy("uid").orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(F.col("reward") * F.col("mask")).over(ahead)
    return tokens.withColumns({"return_": total, "advantage": (total - baseline) * F.col("mask")})


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    """k1 difference, abs, k2 half square, k3 low variance with clamps."""
    d = logp - ref
    if kind in ("kl", "k1"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("mse", "k2"):
        return 0.5 * d * d
    if kind in ("low_var_kl", "k3"):
        kl = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), -d))
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(kl) - kl - 1))
    raise NotImplementedError(kind)


def apply_kl_penalty(tokens: DataFrame, beta: float, kind: str = "k1") -> tuple[DataFrame, DataFrame]:
    """Token rewards less beta times the masked estimate; and the mean over sequences of their masked token mean."""
    kld = kl_estimate(F.col("old_logp"), F.col("ref_logp"), kind) * F.col("mask")
    rows = tokens.withColumn("kld", kld).withColumn("token_reward", F.col("reward") - beta * F.col("kld"))
    per = rows.groupBy("uid").agg((F.sum("kld") / (F.sum("mask") + 1e-8)).alias("kl"))
    return rows, per.agg(F.avg("kl").alias("current_kl"))


def onlinedpo_preference(pairs: DataFrame, reward: str, order: str) -> DataFrame:
    """Of rows 2i and 2i + 1 in order the one of higher reward is chosen, the first at a tie."""
    best = Window.partitionBy("pair").orderBy(F.desc(reward), order)
    return pairs.withColumn("pair", F.floor(F.col(order) / 2)).withColumn("chosen", F.row_number().over(best) == 1)
