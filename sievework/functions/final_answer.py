"""Normal forms of final answers, and the scorers that use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import equality, latex, text

# Replacements and removed expressions, in the order in which they apply.
SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm",
    "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]


def final_form(answer: Column) -> Column:
    """What follows the last ``=``, with units, markup and white space taken out and digits without commas."""
    out = F.substring_index(answer, "=", -1)
    for old, new in [*SUBSTITUTIONS, *((x, "") for x in REMOVED)]:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.regexp_replace(out, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for command in ("text", "textbf", "overline"):
        out = F.regexp_replace(out, rf"\\{command}\{{(.*?)\}}", "$1")
    out = F.regexp_replace(out, r"\\boxed\{(.*)\}", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"frac([^{])(.)", "frac{$1}{$2}"), r"sqrt([^{])", "sqrt{$1}")
    out = F.replace(out, F.lit("$"), F.lit(""))
    bare = F.replace(out, F.lit(","), F.lit(""))
    return F.trim(F.when(bare.rlike("^[0-9]+$"), bare).otherwise(out))


def minerva_score(response: Column, truth: Column) -> Column:
    """score (1 or -1), acc and pred of the last 300 characters."""
    pred = final_form(text.minerva_answer(F.right(response, F.lit(300))))
    right = pred == final_form(truth)
    return F.struct(F.when(right, 1.0).otherwise(-1.0).alias("score"), right.alias("acc"), pred.alias("pred"))


def strict_box_score(response: Column, truth: Column) -> Column:
    """score (1 or -1) and pred of the last box within the last 100 characters."""
    pred = latex.boxed_answer(F.right(response, F.lit(100)))
    return F.struct(F.when(F.coalesce(pred == truth, F.lit(False)), 1).otherwise(-1).alias("score"), pred.alias("pred"))


def tool_use_score(response: Column, truth: Column, turns: Column) -> Column:
    """The strict score; a wrong answer gains 0.05 per turn beyond two, up to 0. A missing answer is empty."""
    s = strict_box_score(response, truth)
    score = F.when(s["score"] > 0, s["score"].cast("double")).otherwise(F.least(F.lit(0.0), s["score"] + (turns - 2) / 2 * 0.1))
    return F.struct(score.alias("score"), F.coalesce(s["pred"], F.lit("")).alias("pred"))


def math_score(response: Column, truth: Column) -> Column:
    """1 if the last box equals the truth in normal form, else 0."""
    return latex.is_equivalent(latex.boxed_answer(response), truth).cast("double")


def boxed_format_score(response: Column, truth: Column, format_score: float = 0.1) -> Column:
    """0.9 for the right answer, 0.1 for thoughts before a box."""
    shaped = response.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z").cast("double")
    return (1 - format_score) * equality.is_graded_equal(latex.boxed_answer(response), truth).cast("double") + format_score * shaped


def code_format(response: Column, language: Column) -> Column:
    """1 for thoughts and an answer that holds a fenced block of the row's language."""
    pattern = F.concat(F.lit("(?sm)\\A<think>\n.*?\n</think>\n<answer>\n.*?```"), language, F.lit(".*?```.*?\n</answer>$"))
    return F.when(F.regexp_like(response, pattern), 1.0).otherwise(0.0)


def char_count_score(response: Column, truth: Column) -> Column:
    return F.when(F.coalesce(latex.boxed_answer(response) == truth, F.lit(False)), 1.0).otherwise(0.0)


def judged_score(split: Column, rule: Column, judge_reply: Column) -> Column:
    """The rule's score on the test split, else 1 for a judge whose last box says True."""
    return F.when(split == "test", rule).otherwise(F.when(F.coalesce(latex.boxed_answer(judge_reply) == "True", F.lit(False)), 1.0).otherwise(0.0))


def score_at_last_token(length: Column, score: Column) -> Column:
    """Token rewards: the score at the last response token, 0 before it."""
    return F.when(length > 0, F.concat(F.array_repeat(F.lit(0.0), length - 1), F.array(score))).otherwise(F.array().cast("array<double>"))


def outputs_equal(a: Column, b: Column) -> Column:
    """Program outputs alike once each line is trimmed and blank ends are gone."""
    bare = lambda s: F.array_join(F.transform(F.split(F.btrim(s, F.lit(" \t\r\n")), "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), "\n")
    return bare(a) == bare(b)
