"""Preference pairs from scored responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first(rewards: Column, value: Column) -> Column:
    return (F.array_position(rewards, value) - 1).cast("int")


def choose(df: DataFrame, prompt: str, responses: str, rewards: str, how: str, penalty: float = 0.0) -> DataFrame:
    """prompt, chosen, rejected, margin per row of arrays. ``random``: the first two; ``max_random``: the best and the
    first other; ``max_min``: the best and the worst; ``max_max``: the best two; ``max_min_p``: the best and the worst by
    reward less ``penalty`` a character. First indices win ties; rows of equal rewards give no pair; the pair is
    oriented by reward."""
    r = F.col(rewards)
    if how == "random":
        i, j = F.lit(0), F.lit(1)
    elif how == "max_random":
        i = _first(r, F.array_max(r))
        j = F.when(i == 0, 1).otherwise(0)
    elif how == "max_min":
        i, j = _first(r, F.array_max(r)), _first(r, F.array_min(r))
    elif how == "max_max":
        order = F.array_sort(F.transform(r, lambda x, k: F.struct((-x).alias("x"), k.alias("k"))))
        i, j = order[0]["k"], order[1]["k"]
    elif how == "max_min_p":
        lengths = F.transform(F.col(responses), lambda s: F.length(s) * penalty)
        adjusted = F.zip_with(r, lengths, lambda x, n: x - n)
        i, j = _first(adjusted, F.array_max(adjusted)), _first(adjusted, F.array_min(adjusted))
    else:
        raise ValueError(how)
    picked = df.where(F.size(r) >= 2).withColumns({"i": i, "j": j}).where(F.get(r, F.col("i")) != F.get(r, F.col("j")))
    best = F.when(F.get(r, F.col("i")) > F.get(r, F.col("j")), F.col("i")).otherwise(F.col("j"))
    worst = F.col("i") + F.col("j") - best
    at = lambda k: F.get(F.col(responses), k)
    return picked.select(prompt, at(best).alias("chosen"), at(worst).alias("rejected"), (F.get(r, best) - F.get(r, worst)).alias("margin"))


def encoded_pair(prompt: Column, chosen: Column, rejected: Column, length: int, eos: int | None = None) -> Column:
    """input_ids and attention_mask of a prompt's ids with the chosen and with the rejected response's, in this order;
    ``eos`` ends a response, and both are cut or filled with 0 at the right to ``length``."""

    def fitted(ids: Column) -> Column:
        return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("bigint"), length)), 1, length)

    end = F.array().cast("array<bigint>") if eos is None else F.array(F.lit(eos).cast("bigint"))
    whole = [F.concat(*(x.cast("array<bigint>") for x in (prompt, response)), end) for response in (chosen, rejected)]
    masks = [F.transform(ids, lambda _: F.lit(1).cast("bigint")) for ids in whole]
    return F.struct(F.array(*map(fitted, whole)).alias("input_ids"), F.array(*map(fitted, masks)).alias("attention_mask"))
