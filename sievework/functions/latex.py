"""Answers in LaTeX: balanced boxes, normalisation and numeric equality, for Arrow-batched functions.

Symbolic equality needs a computer algebra system and isn't covered; numbers, percentages, fractions, tuples and equal
normal forms are."""

import re
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf

from sievework.shipping import ship

#: Characters whose suffixes are sorted together.
REPEAT_CHARS = 1 << 20
#: Markup that carries no meaning, and what it becomes.
PLAIN = [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("\\%", ""), ("%", "")]


def last_boxed(text: str | None) -> str | None:
    """The last ``\\boxed{...}`` or ``\\fbox{...}`` with its braces in balance; ``\\boxed x`` ends at a dollar sign."""
    if text is None:
        return None
    at = max(text.rfind("\\boxed"), text.rfind("\\fbox"))
    if at < 0:
        return None
    if text.startswith("\\boxed ", at):
        return text[at:].split("$")[0]
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth == 0:
                return text[at : i + 1]
    return None


def unboxed(box: str | None) -> str | None:
    """What a box holds; null for anything that isn't one."""
    if box is None:
        return None
    if box.startswith("\\boxed "):
        return box[len("\\boxed ") :]
    found = re.fullmatch(r"\\f?boxe?d?\{(.*)\}", box, re.S)
    return found[1] if found else None


def _braced(text: str, command: str, n: int) -> str:
    """``n`` arguments of a command in braces, where they are single characters."""
    one = r"\s*(\{(?:[^{}]|\{[^{}]*\})*\}|[^{\s])"
    wrap = lambda a: a if a.startswith("{") else "{" + a + "}"
    return re.sub(re.escape(command) + one * n, lambda m: command + "".join(map(wrap, m.groups())), text)


def normal_form(text: str) -> str:
    for old, new in PLAIN:
        text = text.replace(old, new)
    parts = text.split("\\text{ ")
    if len(parts) > 2:
        raise ValueError("two units")
    text = parts[0].replace(" .", " 0.").replace("{.", "{0.")
    if text.startswith("."):
        text = "0" + text
    if text.count("=") == 1 and len(text.split("=")[0]) <= 2:
        text = text.split("=")[1]
    text = _braced(_braced(text, "\\sqrt", 1).replace(" ", ""), "\\frac", 2)
    if text == "0.5":
        text = "\\frac{1}{2}"
    found = re.fullmatch(r"(-?(?:0|[1-9][0-9]*))/(-?(?:0|[1-9][0-9]*))", text)
    return f"\\frac{{{found[1]}}}{{{found[2]}}}" if found else text


def equivalent(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is b
    try:
        return normal_form(a) == normal_form(b)
    except ValueError:
        return a == b


def number(text: str) -> float | None:
    """The value of a number, a percentage or a fraction; thousands separators are dropped."""
    bare = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text.strip().strip("$"))
    try:
        if bare.endswith("%"):
            return float(bare.rstrip("\\%")) / 100
        found = re.fullmatch(r"(-?)\\frac\{(-?\d+)\}\{(-?\d+)\}", bare)
        return float(Fraction(int(found[1] + found[2] if not found[1] or found[2][0] != "-" else found[2][1:]), int(found[3]))) if found else float(bare)
    except (ValueError, ZeroDivisionError):
        return None


def split_tuple(text: str) -> list[str]:
    """The elements of a bracketed list, else the text itself."""
    bare = text.strip()
    if len(bare) > 2 and bare[0] in "([" and bare[-1] in ")]" and not re.search(r"[()\[\]]", bare[1:-1]):
        parts = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", bare[1:-1]).split(",")
        return [p.strip() for p in parts]
    return [bare]


def math_equal(a: str | None, b: str | None, tolerance: float = 1e-4) -> bool:
    """Equal numbers within a relative tolerance, also as percent of each other; element by element for tuples; else
    equal normal forms."""
    if a is None or b is None:
        return False
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return any(abs(x - z) <= tolerance * max(abs(x), abs(z)) for z in (y, y / 100, y * 100))
    p, q = split_tuple(a), split_tuple(b)
    if len(p) > 1 or len(q) > 1:
        return len(p) == len(q) and a.strip()[0] == b.strip()[0] and a.strip()[-1] == b.strip()[-1] and all(math_equal(*z) for z in zip(p, q))
    return equivalent(a, b)


def _ranks(codes: np.ndarray) -> list[np.ndarray]:
    """For each power of two the rank of every position by as many characters from there on, up to the power at which
    all differ. Only positions whose rank is shared are sorted again."""
    order = np.argsort(codes, kind="stable")
    new = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
    starts = np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
    rank = np.empty(len(codes), np.int64)
    rank[order] = starts
    shared = np.bincount(starts, minlength=len(codes)) > 1
    active, out, width = order[shared[starts]], [rank.astype(np.int32)], 1
    while len(active):
        key = rank[active] * (len(codes) + 1) + rank[active + width]
        turn = np.argsort(key, kind="stable")
        active, key = active[turn], key[turn]
        old, at = rank[active], np.arange(len(active))
        changed = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.maximum.accumulate(np.where(changed, at, 0))
        block = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        rank[active] = old + begin - block
        active = active[np.bincount(begin, minlength=len(active))[begin] > 1]
        out.append(rank.astype(np.int32))
        width *= 2
    return out


def repeatness(texts: list[str | None]) -> list[float]:
    """2 sum(LCP) / (n (n + 1)) over the sorted suffixes of each text's characters; 0 for texts of up to one character.
    The suffixes of all texts are ranked together by doubling, each text having characters and an end of its own, and
    neighbours' common prefixes are found from the ranks by halving."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    if not sizes.sum():
        return [0.0] * len(texts)
    text_of = np.repeat(np.arange(len(texts)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    codes = np.zeros(len(text_of), np.int64)
    inside = np.ones(len(text_of), bool)
    inside[ends] = False
    codes[inside] = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    levels = _ranks(codes + (text_of << 22))
    suffixes = np.empty(len(codes), np.int64)
    suffixes[levels[-1]] = np.arange(len(codes))
    a, b = suffixes[:-1], suffixes[1:]
    alike = levels[0][a] == levels[0][b]
    a, b = a[alike], b[alike]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        common[levels[k][a + common] == levels[k][b + common]] += 1 << k
    total = np.bincount(text_of[a], weights=common, minlength=len(texts))
    return [float(2 * s / (n * (n + 1))) if n > 1 else 0.0 for s, n in zip(total, sizes.tolist())]


def boxed_answer(text: Column) -> Column:
    ship(SparkSession.active())

    @pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unboxed(last_boxed(t)))

    return f(text)


def is_equivalent(a: Column, b: Column) -> Column:
    ship(SparkSession.active())

    @pandas_udf("boolean")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([equivalent(p, q) for p, q in zip(x, y)])

    return f(a, b)


def is_math_equal(a: Column, b: Column) -> Column:
    ship(SparkSession.active())

    @pandas_udf("boolean")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([math_equal(p, q) for p, q in zip(x, y)])

    return f(a, b)


def repeatness_score(text: Column) -> Column:
    ship(SparkSession.active())

    @pandas_udf("double")
    def f(s: pd.Series) -> pd.Series:
        out, begin, held = [], 0, 0  # texts of some REPEAT_CHARS characters at once
        texts = s.tolist()
        for at, t in enumerate(texts):
            held += len(t or "")
            if held >= REPEAT_CHARS or at == len(texts) - 1:
                out += repeatness(texts[begin : at + 1])
                begin, held = at + 1, 0
        return pd.Series(out, dtype="float64")

    return f(text)
