"""Token and pair losses, masked reductions and their aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def masked_mean(value: Column, mask: Column) -> Column:
    """An aggregate: sum over the mask / (mask + 1e-8); what stands outside the mask, NaN too, doesn't count."""
    return F.sum(F.when(mask != 0, value * mask).otherwise(0.0)) / (F.sum(mask) + 1e-8)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def kl_reward(score: Column, old: Column, ref: Column, ratio: float) -> Column:
    return score - (old - ref) * ratio


def policy_loss(rows: DataFrame, old: str, new: str, adv: str, low: float, high: float, dual: float) -> DataFrame:
    """Clipped surrogate with a dual clip for negative advantages: loss, clipped, clipped_lower, kl per token."""
    a, d = F.col(adv), clamp(F.col(new) - F.col(old), -20.0, 20.0)
    plain, cut = -a * F.exp(d), -a * clamp(F.exp(d), 1 - low, 1 + high)
    worst = F.greatest(plain, cut)
    return rows.withColumns({
        "loss": F.when(a < 0, F.least(-a * dual, worst)).otherwise(worst), "clipped": (cut > plain).cast("double"), "kl": -d,
        "clipped_lower": ((worst > -a * dual) & (a < 0)).cast("double"),
    })


def aggregate_loss(rows: DataFrame, loss: str, mode: str, key: str = "uid", mask: str = "mask", width: int | None = None) -> DataFrame:
    """One row ``loss``, by one of four modes."""
    value = F.sum(F.col(loss) * F.col(mask))
    if mode == "token-mean":
        return rows.agg((value / F.sum(mask)).alias("loss"))
    per = rows.groupBy(key).agg(value.alias("s"), F.sum(mask).alias("n"))
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg(F.col("s") / F.col("n")).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return per.agg((F.sum("s") / float(width)).alias("loss"))
    raise ValueError(mode)


def gspo_loss(rows: DataFrame, old: str, new: str, adv: str, low: float, high: float, key: str = "uid", mask: str = "mask") -> DataFrame:
    """Ratios of whole sequences, from the mean log ratio; sequence mean of token means."""
    w = Window.partitionBy(key)
    n = F.sum(mask).over(w)
    mean = F.sum((F.col(new) - F.col(old)) * F.col(mask)).over(w) / n
    out = rows.withColumns({"n_live": n, "ratio": F.exp(F.least(mean, F.lit(10.0)))}).where("n_live > 0")
    a, r = F.col(adv), F.col("ratio")
    return aggregate_loss(out.withColumn("loss", F.greatest(-a * r, -a * clamp(r, 1 - low, 1 + high))), "loss", "seq-mean-token-mean", key, mask)


def with_covariance(rows: DataFrame, new: str, adv: str) -> DataFrame:
    """``cov``: the product of a token's centred advantage and centred log-probability."""
    means = rows.agg(F.avg(adv).alias("mean_a"), F.avg(new).alias("mean_l"))
    return rows.crossJoin(F.broadcast(means)).withColumn("cov", (F.col(adv) - F.col("mean_a")) * (F.col(new) - F.col("mean_l"))).drop("mean_a", "mean_l")


def kl_cov_loss(rows: DataFrame, old: str, new: str, adv: str, share: float, coefficient: float, order: str) -> DataFrame:
    """A penalty on the tokens of highest covariance, max(1, share of them), over the plain surrogate. The cut is found
    with a top-k, not a sort of all tokens."""
    out = with_covariance(rows, new, adv)
    n = max(1, int(rows.count() * share))
    last = out.orderBy(F.desc("cov"), order).limit(n).agg(F.max(F.struct(-F.col("cov"), order)).alias("last"))
    d = F.col(new) - F.col(old)
    hit = F.struct((-F.col("cov")).alias("c"), F.col(order).alias("o")) <= F.struct(F.col("last.col1").alias("c"), F.col(f"last.{order}").alias("o"))
    return out.crossJoin(F.broadcast(last)).withColumn("loss", -F.col(adv) * F.exp(d) + F.when(hit, coefficient * F.abs(d)).otherwise(0.0)).drop("last")


def clip_cov_loss(rows: DataFrame, old: str, new: str, adv: str, low: float, high: float, share: float, seed: int, order: str) -> DataFrame:
    """Tokens whose covariance lies within (low, high) lose their gradient with a seeded chance of ``share``."""
    out = with_covariance(rows, new, adv)
    draw = F.pmod(F.xxhash64(F.lit(seed), order), F.lit(1 << 20)) / float(1 << 20)
    hit = (F.col("cov") > low) & (F.col("cov") < high) & (draw < share)
    return out.withColumn("loss", F.when(hit, 0.0).otherwise(-F.col(adv) * F.exp(F.col(new) - F.col(old))))


def geo_mean_loss(rows: DataFrame, old: str, new: str, adv: str, low: float, high: float, key: str = "uid", mask: str = "mask") -> DataFrame:
    """Geometric mean of clipped token ratios per sequence, times the mean advantage."""
    d, a, m = F.col(new) - F.col(old), F.col(adv), F.col(mask)
    cut = clamp(d, -low, high)
    step = F.when(a >= 0, F.least(d, cut)).otherwise(F.greatest(d, cut))
    per = rows.groupBy(key).agg(F.exp(F.sum(step * m) / (F.sum(m) + 1e-8)).alias("r"), (F.sum(a * m) / (F.sum(m) + 1e-8)).alias("a"), F.sum(m).alias("n"))
    return per.where("n > 0").agg(F.avg(-F.col("a") * F.col("r")).alias("loss"))


def value_loss(rows: DataFrame, predicted: str, old: str, returns: str, span: float) -> DataFrame:
    """loss (the larger squared error of the plain and the clipped value) and clipped per token."""
    cut = F.greatest(F.col(old) - span, F.least(F.col(old) + span, F.col(predicted)))
    plain, clipped = (F.col(predicted) - F.col(returns)) ** 2, (cut - F.col(returns)) ** 2
    return rows.withColumns({"loss": F.greatest(plain, clipped), "clipped": (clipped > plain).cast("double")})


def adaptive_kl(steps: DataFrame, order: str, kl: str, n: str, start: float, target: float, horizon: int) -> DataFrame:
    """``beta`` after each step; factors are independent, so that it is a running product."""
    factor = 1.0 + clamp(F.col(kl) / target - 1.0, -0.2, 0.2) * F.col(n) / float(horizon)
    return steps.withColumn("beta", start * F.exp(F.sum(F.log(factor)).over(Window.orderBy(order))))


def dpo_loss(difference: Column, beta: float, kind: str, smoothing: float = 0.0) -> Column:
    if kind == "sigmoid":
        soft = lambda x: F.log1p(F.exp(-x))
        return soft(beta * difference) * (1 - smoothing) + soft(-beta * difference) * smoothing
    if kind == "ipo":
        return (difference - 1 / (2 * beta)) ** 2
    raise ValueError(kind)


def sppo_loss(difference: Column, reward: Column, eta: float) -> Column:
    return (difference - eta * reward) ** 2


def ce_reward_loss(total: Column, right: Column, beta: float) -> Column:
    """Binary cross-entropy of the sigmoid of beta times a sequence's total, from a form that no length overflows; a
    logarithm counts as -100 at least."""
    x = F.when(right, -beta * total).otherwise(beta * total)
    return F.least(F.lit(100.0), F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


def dense_flops(length: Column, weights: int, head: int, heads: int, layers: int) -> Column:
    """6 times weights and tokens, and 12 times the attention's share of squared tokens."""
    return 6.0 * weights * length + 12.0 * head * heads * layers * length * length
