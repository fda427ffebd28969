"""Token arrays: padding, truncation, masks and folds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import let


def head_and_tail(tokens: Column, most: int, tail: int) -> Column:
    """At most ``most`` tokens: the head, and the last ``tail`` where something had to go."""
    return F.when(F.size(tokens) > most, F.concat(F.slice(tokens, 1, most - tail), F.slice(tokens, -tail, tail))).otherwise(tokens)


def truncated(tokens: Column, most: int, how: str) -> Column:
    """``left`` keeps the tail, ``right`` the head, ``middle`` half of each, ``error`` fails on longer input."""
    keep = {
        "left": F.slice(tokens, -most, most),
        "right": F.slice(tokens, 1, most),
        "middle": F.concat(F.slice(tokens, 1, most // 2), F.slice(tokens, -(most - most // 2), most - most // 2)),
    }
    if how == "error":
        message = F.concat(F.lit("length "), F.size(tokens).cast("string"), F.lit(f" is above {most}"))
        return F.when(F.size(tokens) > most, F.raise_error(message).cast("array<bigint>")).otherwise(tokens)
    return F.when(F.size(tokens) > most, keep[how]).otherwise(tokens)


def padded(tokens: Column, width: int, value: Column, left: bool = False) -> Column:
    fill = F.array_repeat(value, F.greatest(F.lit(0), width - F.size(tokens)))
    return F.concat(fill, tokens) if left else F.concat(tokens, fill)


def without_left_padding(ids: Column, mask: Column) -> Column:
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.when(n > 0, F.slice(ids, -F.greatest(n, F.lit(1)), F.greatest(n, F.lit(1)))).otherwise(F.slice(ids, 1, 0))


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums."""
    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, x: F.struct((a["s"] + x).alias("s"), F.concat(a["out"], F.array(a["s"] + x)).alias("out"))
    return F.aggregate(values, start, step, lambda a: a["out"])


def until_first(ids: Column, ends: list[int]) -> Column:
    """1 up to the first end id, itself included, then 0."""
    hit = F.array_position(F.transform(ids, lambda x: x.isin(*ends)), True)
    return F.transform(ids, lambda x, i: F.when((hit == 0) | (i < hit), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    return F.transform(running_sum(mask), lambda x: F.greatest(x - 1, F.lit(0)))


def masked_sum(values: Column, mask: Column) -> Column:
    return F.aggregate(F.zip_with(values, mask, lambda v, m: F.when(m != 0, v * m).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def discounted_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """Reverse running sum with discount, reset where the mask is 0."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("g"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        g = x["r"] + gamma * a["g"]
        return F.struct((g * x["m"]).alias("g"), F.concat(F.array(g), a["out"]).alias("out"))

    return F.aggregate(pairs, start, step, lambda a: a["out"])


def generalized_advantage(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Advantages before whitening; positions outside the mask hand on the state behind them."""
    rows = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("adv"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = x["r"] + gamma * a["next"] - x["v"] + gamma * lam * a["adv"]
        adv = new * x["m"] + (1 - x["m"]) * a["adv"]
        value = x["v"] * x["m"] + (1 - x["m"]) * a["next"]
        return F.struct(value.alias("next"), adv.alias("adv"), F.concat(F.array(adv), a["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda a: a["out"])


def log_sum_exp(values: Column) -> Column:
    shifted = lambda v, most: most + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - most)))
    return let(values, lambda v: let(F.array_max(v), lambda most: shifted(v, most)))


def entropy(logits: Column) -> Column:
    spread = lambda v, total: total - F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - total) * x)
    return let(logits, lambda v: let(log_sum_exp(v), lambda total: spread(v, total)))
