"""Answer normalisation, extraction and text rewards as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, as a character class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalize_answer(s: Column) -> Column:
    """Lower case, without ASCII punctuation and English articles, white space collapsed."""
    bare = F.regexp_replace(F.lower(s), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def normalize_string(s: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(s)), r"\s+", " ")


def boxed_or_tagged(s: Column) -> Column:
    """The first ``\\boxed{...}`` up to its first closing brace, else the first answer tag; null without either."""
    box, tag = r"(?s)\\boxed\{(.*?)\}", r"(?s)<answer>(.*?)</answer>"
    return F.when(s.rlike(box), F.trim(F.regexp_extract(s, box, 1))).when(s.rlike(tag), F.trim(F.regexp_extract(s, tag, 1)))


def exact_match(prediction: Column, goldens: Column) -> Column:
    return F.exists(goldens, lambda g: normalize_answer(g) == normalize_answer(prediction))


def contains_match(prediction: Column, goldens: Column) -> Column:
    return F.exists(goldens, lambda g: F.contains(normalize_answer(prediction), normalize_answer(g)))


def answer_tags(s: Column) -> Column:
    """How many opening and closing answer tags there are."""
    return F.regexp_count(s, F.lit("<answer>")) + F.regexp_count(s, F.lit("</answer>"))


def judge_verdict(reply: Column) -> Column:
    """score and explanation of the last brace block of a judge's reply; a score that isn't 0 or 1 is -1."""
    block = F.try_element_at(F.regexp_extract_all(reply, F.lit(r"\{[^{}]*\}"), F.lit(0)), F.lit(-1))
    score = F.regexp_extract(block, r'"score"\s*:\s*([0-9]+)', 1)
    why = F.regexp_extract(block, r'"explanation"\s*:\s*"(.*)"', 1)
    return F.struct(F.when(score.isin("0", "1"), score.cast("int")).otherwise(-1).alias("score"), F.coalesce(why, F.lit("")).alias("explanation"))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once per row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_ngrams(words: Column, n: int) -> Column:
    """n-grams of an array of words, joined by a space; none when there are fewer words."""

    def grams(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - n + 1)
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, grams)


def fenced_code(s: Column, language: str | None) -> Column:
    """The last fenced block of a language, else the empty string; without a language nothing is found."""
    if language is None:
        return F.lit("")
    found = F.regexp_extract_all(s, F.lit(f"(?s)```{language}\n(.*?)```"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def gsm8k_answer(s: Column, strict: bool) -> Column:
    """The number of the last 300 characters: after the last ``####``, or the last number at all; null without one."""
    tail = F.right(s, F.lit(300))
    if strict:
        found = F.try_element_at(F.regexp_extract_all(tail, F.lit(r"#### (\-?[0-9\.\,]+)"), F.lit(1)), F.lit(-1))
        return F.replace(F.replace(found, F.lit(","), F.lit("")), F.lit("$"), F.lit(""))
    found = F.filter(F.regexp_extract_all(tail, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.try_element_at(found, F.lit(-1))


def choice_letter(s: Column) -> Column:
    """The first ``Answer: X`` with X from A to D, in any case; null without one."""
    return F.when(s.rlike(r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?"), F.upper(F.regexp_extract(s, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)))


def minerva_answer(s: Column) -> Column:
    """What follows the last ``Answer:``, else ``[INVALID]``."""
    found = F.regexp_extract_all(s, F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("[INVALID]"))


def mixed_case_first(s: Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, F.lit(2), F.length(s))))


def hellaswag_clean(s: Column) -> Column:
    out = F.replace(F.trim(s), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(out, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def format_reward(s: Column) -> Column:
    return F.when(s.rlike(r"(?sm)^<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>$"), 1.0).otherwise(0.0)


def tag_count_reward(s: Column) -> Column:
    total = F.lit(0.0)
    for mark in ("<think>\n", "\n</think>\n", "\n<answer>\n", "\n</answer>"):
        total = total + F.when(F.regexp_count(s, F.lit(mark)) == 1, 0.25).otherwise(0.0)
    return total


def reasoning_steps_reward(s: Column) -> Column:
    steps = F.regexp_count(s, F.lit(r"(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"))
    return F.least(F.lit(1.0), steps / F.lit(3.0))


def cosine_reward(right: Column, length: Column, longest: int, wrong: tuple[float, float] = (-1.0, -0.5), good: tuple[float, float] = (0.5, 1.0)) -> Column:
    """From the far to the near end of a range along a half cosine of the length; wrong answers run the other way."""
    turn = F.cos(length / F.lit(float(longest)) * F.pi())
    low = F.when(right, good[0]).otherwise(wrong[1])
    high = F.when(right, good[1]).otherwise(wrong[0])
    return low + 0.5 * (high - low) * (1.0 + turn)


def repetition_penalty(s: Column, n: int, most: float) -> Column:
    """(1 - distinct / all n-grams) times ``most``, which isn't positive; 0 for short texts."""
    if most > 0:
        raise ValueError("the penalty must not be positive")
    words = F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != "")
    share = lambda g: F.when(F.size(g) == 0, 0.0).otherwise((1.0 - F.size(F.array_distinct(g)) / F.size(g)) * most)
    return let(word_ngrams(words, n), share)


def soft_overlong(length: Column, longest: int, buffer: int) -> Column:
    """0 below the buffer, linear inside, -1 beyond."""
    expected = longest - buffer
    return F.when(length <= expected, 0.0).when(length <= longest, (expected - length) / F.lit(float(buffer))).otherwise(-1.0)


def overlong_penalty(length: Column, longest: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - (longest - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def truncate_sides(s: Column, most: int, side: str) -> Column:
    """``left`` keeps the head, ``right`` the tail, anything else both halves, with a mark at the cut."""
    short = F.length(s) <= most
    if side == "left":
        cut = F.concat(F.substring(s, 1, most), F.lit("...(truncated)"))
    elif side == "right":
        cut = F.concat(F.lit("(truncated)..."), F.right(s, F.lit(most)))
    else:
        half = most // 2
        cut = F.concat(F.substring(s, 1, half), F.lit("...(truncated)..."), F.right(s, F.lit(half)))
    return F.when(short, s).otherwise(cut)


def tool_calls(s: Column) -> Column:
    """content without tool calls, and the well-formed calls as (name, arguments) with arguments as JSON text."""
    bodies = F.regexp_extract_all(s, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    parsed = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    calls = F.filter(parsed, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())
    return F.struct(F.regexp_replace(s, r"(?s)<tool_call>.*?</tool_call>", "").alias("content"), calls.alias("calls"))
