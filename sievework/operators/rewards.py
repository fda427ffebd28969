"""Rule rewards: the ternary and binary answer ladders and scorers by data source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.functions.final_answer import score_at_last_token


def _abstains(answer: Column) -> Column:
    return F.contains(T.normalize_answer(answer), F.lit("i dont know"))


def answer_ladder(
    response: Column, goldens: Column, judge: Column | None = None, ook: Column | None = None,
    right: float = 1.0, abstain: float = 0.0, abstain_ook: float = 1.0, wrong: float = -1.0,
) -> Column:
    """No boxed or tagged answer is wrong; an abstention pays ``abstain`` and on out-of-knowledge rows ``abstain_ook``,
    where any other answer is wrong; "invalid question" is wrong; then an exact match with any golden or a judge's 1 is
    right. ``judge`` is an array with a verdict per golden."""
    answer = T.boxed_or_tagged(response)
    hit = T.exact_match(answer, goldens)
    if judge is not None:
        hit = hit | F.exists(judge, lambda v: v == 1)
    ladder = F.when(answer.isNull(), wrong)
    if ook is not None:
        ladder = ladder.when(ook & _abstains(answer), abstain_ook).when(ook, wrong)
    ladder = ladder.when(_abstains(answer), abstain).when(F.contains(T.normalize_answer(answer), F.lit("invalid question")), wrong)
    return ladder.when(hit, right).otherwise(wrong)


def ternary(response: Column, goldens: Column, judge: Column) -> Column:
    return answer_ladder(response, goldens, judge)


def ternary_em(response: Column, goldens: Column) -> Column:
    return answer_ladder(response, goldens)


def ternary_ook(response: Column, goldens: Column, judge: Column, ook: Column) -> Column:
    return answer_ladder(response, goldens, judge, ook)


def ternary_double(response: Column, goldens: Column, judge: Column) -> Column:
    return answer_ladder(response, goldens, judge, right=2.0)


def binary(response: Column, goldens: Column, judge: Column) -> Column:
    return answer_ladder(response, goldens, judge, abstain=-1.0)


def binary_ook(response: Column, goldens: Column, judge: Column, ook: Column) -> Column:
    """As the binary ladder, but an abstention on an out-of-knowledge row is right."""
    return F.when(ook & _abstains(T.boxed_or_tagged(response)), 1.0).otherwise(binary(response, goldens, judge))


def qa_em(response: Column, goldens: Column, format_score: float = 0.0, score: float = 1.0, substring: bool = False) -> Column:
    """Exact (or substring) match; a response of more than 10 answer tags gets a quarter of the score."""
    answer = T.boxed_or_tagged(response)
    hit = T.contains_match(answer, goldens) if substring else T.exact_match(answer, goldens)
    paid = F.when(T.answer_tags(response) > 10, score / 4).otherwise(score)
    return F.when(answer.isNull(), 0.0).when(hit, paid).otherwise(format_score)


def gsm8k(response: Column, truth: Column, strict: bool = True, format_score: float = 0.0) -> Column:
    answer = T.gsm8k_answer(response, strict)
    return F.when(answer.isNull(), 0.0).when(answer == truth, 1.0).otherwise(format_score)


def judged_evaluation(answer: Column, goldens: Column, judge: Column) -> Column:
    """The evaluator's ladder, golden by golden: an abstention scores 0 and stops, an exact match scores 1 and stops,
    "invalid question" scores -1 without stopping, else the judge's verdict; the last verdict stands."""
    low = F.lower(F.trim(answer))
    start = F.struct(F.lit(False).alias("stop"), F.lit(-1).alias("score"))

    def step(a: Column, x: Column) -> Column:
        verdict = F.when(x["j"] == 1, 1).otherwise(-1)
        score = F.when(_abstains(low), 0).when(T.normalize_answer(x["g"]) == T.normalize_answer(low), 1).when(F.contains(low, F.lit("invalid question")), -1).otherwise(verdict)
        stop = _abstains(low) | (score == 1)
        return F.when(a["stop"], a).otherwise(F.struct(stop.alias("stop"), score.alias("score")))

    pairs = F.arrays_zip(goldens.alias("g"), judge.alias("j"))
    return F.when(answer.isNull(), -1).otherwise(F.aggregate(pairs, start, step, lambda a: a["score"]))


#: Scorers by data source, as a prefix of its name; the first that fits is taken.
SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def register_scorer(prefix: str, scorer: Callable[[Column, Column], Column]) -> None:
    """Name a scorer; naming another under the same prefix is an error."""
    if SCORERS.setdefault(prefix, scorer) is not scorer:
        raise ValueError(f"{prefix} is taken")


def score_by_source(source: Column, response: Column, goldens: Column) -> Column:
    """The scorer of each row's data source; sources without one score null."""
    out = F.lit(None).cast("double")
    for prefix, scorer in reversed(SCORERS.items()):
        out = F.when(source.startswith(prefix), scorer(response, goldens)).otherwise(out)
    return out


def batch_rewards(df: DataFrame, length: str, scorer: Callable[[DataFrame], Column], extras: list[str] | None = None) -> DataFrame:
    """``df`` with the rewards of a scorer that sees the whole batch: ``rewards`` has the score at the last of a row's
    ``length`` tokens and 0 before it, ``acc`` is the score as a number, and ``extras`` are further fields of a scorer
    that gives a struct with ``score``. Where ``df`` has ``rm_scores`` they are the rewards, and nothing is scored."""
    if "rm_scores" in df.columns:
        return df.withColumn("rewards", F.col("rm_scores"))
    scored = df.withColumn("acc", scorer(df))
    score = F.col("acc.score") if extras is not None else F.col("acc")
    found = {x: F.col("acc")[x] for x in extras or ()}
    return scored.withColumns({**found, "rewards": score_at_last_token(F.col(length), score.cast("double")), "acc": score.cast("double")})
