"""Whether two answers are mathematically the same: LaTeX read as plain text, answers in plain form, and two graders, a
lenient one (numbers, percentages, intervals, tuples, matrices, expressions) and one that is strict about integers and
fractions. Expressions are compared by ``symbolic``."""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sievework.functions import latex
from sievework.functions.matching import UNITS
from sievework.functions.symbolic import expressions_equal, parse, remembered, value
from sievework.shipping import ship

# Plain forms of LaTeX symbols, and spacing.
SYMBOLS = {"\\pi": "pi", "\\infty": "inf", "\\cup": "U", "\\cdot": "*", "\\times": "*", "\\le": "≤", "\\leq": "≤", "\\ge": "≥", "\\geq": "≥", "\\ne": "≠", "\\neq": "≠", "\\pm": "±", "\\circ": "∘"}
SPACING = {"\\,": " ", "\\;": " ", "\\:": " ", "\\ ": " ", "\\quad": "  ", "\\!": "", "\\\\": "\n"}
# What an expression that is graded must not hold.
REFUSED = re.compile(r"\^\{|\^\(|\^[0-9]+\^|\^[0-9][0-9]+")
PIECES = re.compile(r"\\[a-zA-Z]+|\\.|.", re.S)
NEEDS = {"frac": (2, "{}/{}"), "sqrt": (1, "sqrt({})")}
FRACTION = re.compile(r"-?[0-9]+.?/0*[1-9][0-9]*.?$")


def latex_text(text: str) -> str:
    """LaTeX as plain text, by one pass with a stack, for nesting of any depth: a/b for fractions, sqrt(a) for roots of
    any index, SYMBOLS and Greek letters as characters, braces and unknown commands gone and what is in braces kept.
    Braces out of balance raise ValueError."""
    stack: list[tuple[str, list[str]]] = [("group", [])]

    def put(piece: str) -> None:
        while True:
            kind, held = stack[-1]
            held.append(piece)
            if kind not in NEEDS or len(held) < NEEDS[kind][0]:
                return
            stack.pop()
            piece = NEEDS[kind][1].format(*held)

    for piece in PIECES.findall(text):
        waiting = stack[-1][0] in NEEDS
        if waiting and piece.isspace():
            continue
        if piece == "{":
            stack.append(("group", []))
        elif piece == "[" and stack[-1] == ("sqrt", []):
            stack.append(("index", []))
        elif piece == "]" and stack[-1][0] == "index":
            stack.pop()
        elif piece == "}":
            if len(stack) < 2 or stack[-1][0] != "group":
                raise ValueError("braces out of balance")
            put("".join(stack.pop()[1]))
        elif piece in ("\\frac", "\\dfrac", "\\tfrac", "\\cfrac"):
            if not waiting:
                put(" ")  # so that a mixed number's parts stay apart
            stack.append(("frac", []))
        elif piece == "\\sqrt":
            stack.append(("sqrt", []))
        elif piece[0] != "\\":
            put(piece)
        elif piece in SYMBOLS or piece in SPACING:
            put(SYMBOLS.get(piece, SPACING.get(piece, "")))
        elif not piece[1:].isalpha():
            put(piece[1:])
        else:
            name = piece[1:].replace("lambda", "lamda").replace("Lambda", "Lamda")
            try:
                put(unicodedata.lookup(f"GREEK {'CAPITAL' if name[0].isupper() else 'SMALL'} LETTER {name.upper()}"))
            except KeyError:
                pass
    if len(stack) > 1:
        raise ValueError("braces out of balance")
    return "".join(stack[0][1]).strip()


def without_commas(text: str) -> str:
    """Commas between thousands gone, those of tuples kept."""
    return re.sub(r"(?<=\d),(?=\d\d\d(?!\d))", "", text)


def _rounded(text: str) -> str | None:
    """A number within 1e-7 of an integer as that integer."""
    try:
        x = float(text)
        return str(round(x)) if abs(x - round(x)) <= 1e-7 else None
    except (ValueError, OverflowError):
        return None


@remembered
def plain_answer(answer: str | None) -> str | None:
    """``matching.plain_answer`` with the whole of LaTeX read by ``latex_text``."""
    if answer is None:
        return None
    worded = re.search(r"^\\text\{(.+?)\}$", answer)
    out = worded[1] if worded else answer
    for old, new in (("\\%", ""), ("\\$", ""), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")):
        out = out.replace(old, new)
    for unit in UNITS:
        out = re.sub(rf"{unit}(es)?(s)? *(\^[0-9]+)?", "", out)
    out = re.sub(r"\^ *\\circ", "", out)
    if out[:1] == "{" and out[-1] == "}":
        out = out[1:-1]
    out = re.sub(r",\\! *", "", out)
    out = _rounded(out) or out
    if "\\" in out:
        try:
            out = latex_text(out)
        except ValueError:
            pass
    out = re.sub("([0-9]) +([0-9])", r"\1+\2", re.sub("- *", "-", out)).lower()
    return _rounded(without_commas(out)) or out


@remembered
def grade_answer(given: str | None, truth: str | None) -> bool:
    """Equal normal forms or, element by element of a tuple in equal brackets, equal expressions; fractions must be
    written alike, and an integer only matches an integer."""
    if given is None or truth is None:
        return False
    if latex.equivalent(latex_unwrapped(given), latex_unwrapped(truth)):
        return True
    a, b = plain_answer(given), plain_answer(truth)
    if a == b:
        return True
    if not a or not b:
        return False
    p, q = _elements(a), _elements(b)
    if len(p) != len(q) or len(q) > 1 and (a[0], a[-1]) != (b[0], b[-1]):
        return False

    def same(x: str, y: str) -> bool:
        if FRACTION.match(x) and FRACTION.match(y):
            return x == y
        if (_rounded(without_commas(x)) is None) != (_rounded(without_commas(y)) is None):
            return False
        both = f"({y})-({x})"
        letters = {c for c in both.replace("sqrt", "").replace("frac", "") if c.isalpha()}
        return len(letters) <= 2 and not REFUSED.search(both) and expressions_equal(x, y)

    return all(map(same, p, q))


def latex_unwrapped(text: str) -> str:
    """What a text that is one ``\\text{...}`` holds."""
    worded = re.search(r"^\\text\{(.+?)\}$", text.strip())
    return worded[1].strip() if worded else text.strip()


def _elements(text: str) -> list[str]:
    text = without_commas(text)
    if len(text) > 2 and text[0] in "()[]" and text[-1] in "()[]" and not re.search(r"[()\[\]]", text[1:-1]):
        return [x.strip() for x in text[1:-1].split(",")]
    return [text] if text else []


def _prepared(text: str, pi: float) -> str | float:
    """Without a leading dollar or a trailing per cent sign; a number to a base is its digits, one with pi its value."""
    if re.match(r"\$\d", text):
        return text[1:]
    if re.fullmatch(r"\d+(\.\d+)?\\?%", text):
        return text.rstrip("\\%")
    if "_" in text:
        return int(float(text.split("_")[0]))
    if "\\pi" in text:
        x = value(text.replace("\\pi", f"({pi})"))
        return text if x is None else x
    return text


def _number(x: str | float) -> float | None:
    try:
        return float(str(x).replace("{,}", "").replace(",", ""))
    except ValueError:
        return None


def _matrix(text: str) -> list[list[str]] | None:
    """The entries of a LaTeX matrix or of bracketed rows."""
    found = re.fullmatch(r"\\begin\{([a-zA-Z]?matrix|array)\}(?:\{[clr|]*\})?(.*)\\end\{\1\}", text, re.S)
    if found:
        return [[x.strip() for x in row.split("&")] for row in found[2].split("\\\\") if row.strip()]
    found = re.fullmatch(r"(?:Matrix\()?\[\s*(\[.*\])\s*\]\)?", text, re.S)
    rows = re.findall(r"\[([^\[\]]*)\]", found[1]) if found else None
    return [[x.strip() for x in row.split(",")] for row in rows] if rows else None


def _interval(text: str) -> str:
    found = re.fullmatch(r"Interval(\.Ropen|\.Lopen|\.open)?\((.*)\)", text, re.S)
    if not found:
        return text
    ends = {None: "[]", ".Ropen": "[)", ".Lopen": "(]", ".open": "()"}[found[1]]
    return ends[0] + found[2] + ends[1]


@remembered
def math_equal(given: str | None, truth: str | None, percent: bool = True, tolerance: float = 1e-4, pi: float = math.pi) -> bool:
    """Equal texts but for case and spaces; numbers within a relative tolerance, also a hundredfold off with
    ``percent``; intervals, points, tuples, lists and matrices entry by entry; else equal expressions, or constants
    within the tolerance."""
    if given is None or truth is None:
        return False
    try:
        x, y = _prepared(given, pi), _prepared(truth, pi)
    except (ValueError, OverflowError):
        return False
    if isinstance(x, str) and isinstance(y, str) and (x.strip().lower() == y.strip().lower() or x.replace(" ", "") == y.replace(" ", "")):
        return True
    a, b = _number(x), _number(y)
    if a is not None and b is not None:
        return any(math.isclose(z, a, rel_tol=tolerance) for z in ((b / 100, b, b * 100) if percent else (b,)))
    p, q = _interval(str(x).strip()), str(y).strip()
    if not p or not q:
        return False
    bare = lambda s: re.sub(r"[{}()]", "", s)
    loose = p[0] == "[" and p[-1] == "]" and q[0] != "(" or p[0] == "(" and p[-1] == ")" and q[0] != "["
    if bare(p) == bare(q) or loose and bare(p.strip("[]()")) == bare(q.strip("[]()")):
        return True
    each = lambda s, t: len(s) == len(t) and all(math_equal(u.strip(), v.strip(), percent, tolerance, pi) for u, v in zip(s, t))
    m, n = _matrix(p), _matrix(q)
    if m or n:
        return bool(m and n) and len(m) == len(n) and all(map(each, m, n))
    if p.startswith("Point") and q[0] == "(":
        p = p[5:]
    if p[0] in "([" and p[-1] in ")]" and (p[0], p[-1]) == (q[0], q[-1]) and each(_listed(p[1:-1]), _listed(q[1:-1])):
        return True
    if "," in p and "," in q:
        s, t = _listed(p), _listed(q)
        return len(s) > 1 and (each(s, t) or each(_listed(p.strip("()[]")), _listed(q.strip("()[]"))) and p[0] == q[0])
    if expressions_equal(p, q):
        return True
    a, b = value(p), value(q)
    return a is not None and b is not None and math.isclose(a, b, rel_tol=tolerance)


def _listed(text: str) -> list[str]:
    """The parts of a list, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth <= 0:
            out.append("")
        else:
            out[-1] += c
    return out


def correct(given: str | None, truth: str | None) -> bool:
    """Right by the strict grader or else by the lenient one, there with two values of pi."""
    return grade_answer(given, truth) or any(math_equal(given, truth, pi=pi) for pi in (math.pi, 3.14))


def verified(reply: str | None, truth: str | None) -> float | None:
    """1 or 0 for a reply's boxed answer against a truth in a box or plain; null where the truth can't be read."""
    gold = latex.unboxed(latex.last_boxed(truth)) if truth and "\\box" in truth else (truth or "").strip().strip("$")
    readable = bool(gold) and (parse(gold) is not None or _matrix(gold) is not None or all(parse(x) is not None for x in _listed(gold.strip("()[]"))))
    if not readable:
        return None
    return float(math_equal(latex.unboxed(latex.last_boxed(reply)), gold))


def numeric_equal(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Whether two numbers differ by no more than a share of the larger one."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def _pairwise(f, kind: str, a: Column, b: Column) -> Column:
    ship(SparkSession.active())

    @pandas_udf(kind)
    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([f(p, q) for p, q in zip(x, y)], dtype=object)

    return each(a, b)


def is_math_equal(given: Column, truth: Column) -> Column:
    return _pairwise(math_equal, "boolean", given, truth)


def is_graded_equal(given: Column, truth: Column) -> Column:
    return _pairwise(grade_answer, "boolean", given, truth)


def is_correct(given: Column, truth: Column) -> Column:
    return _pairwise(correct, "boolean", given, truth)


def accuracy_reward(reply: Column, truth: Column) -> Column:
    return _pairwise(verified, "double", reply, truth)


def plain(answer: Column) -> Column:
    ship(SparkSession.active())

    @pandas_udf("string")
    def each(s: pd.Series) -> pd.Series:
        return s.map(plain_answer)

    return each(answer)
