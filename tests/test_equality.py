"""Graders and LaTeX reading against literals and a plain recursive version."""

import math
import random
import re

import pytest

from sievework.functions import equality as E
from sievework.functions import symbolic as S


@pytest.mark.parametrize("a,b,want", [
    ("(x+1)^2", "x^2+2x+1", True), ("\\frac{x^2-1}{x-1}", "x+1", True), ("\\sqrt{8}", "2\\sqrt{2}", True), ("\\sqrt{x^2}", "x", False), ("\\sin^2 x+\\cos^2 x", "1", True),
    ("2\\pi", "6.2832", True), ("50%", "0.5", True), ("$12", "12", True), ("11_2", "11", True), ("Interval.Ropen(0,1)", "[0,1)", True), ("[0,1)", "Interval.Ropen(0,1)", False),
    ("(1,\\frac{1}{2})", "(1,0.5)", True), ("(1,2)", "(1,3)", False), ("1,2,3", "1, 2, 3", True), ("Point(1,2)", "(1,2)", True),
    ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "[[1,2],[3,4]]", True), ("\\begin{pmatrix}1&2\\\\3&5\\end{pmatrix}", "[[1,2],[3,4]]", False), ("[[1,2]]", "[[1],[2]]", False),
    ("3!", "6", True), ("e^{x+y}", "e^x e^y", True), ("x^{10}", "x^5x^5", True), ("1/0", "2/0", False), ("{x}", "x", True), ("", "1", False), (None, "1", False), ("a", "b", False),
])
def test_math_equal(a, b, want):
    assert E.math_equal(a, b) is want


@pytest.mark.parametrize("a,b,want", [
    ("\\frac{1}{2}", "1/2", True), ("\\frac{2}{4}", "\\frac{1}{2}", False), ("2.0", "2", True), ("2", "4/2", False), ("(1,2)", "(1, 2)", True), ("[1,2]", "(1,2)", False),
    ("x^2+2x+1", "(x+1)^2", True), ("1,000", "1000", True), ("7\\frac{3}{4}", "31/4", True), ("5 cm", "5", True), ("\\sqrt{12}", "2\\sqrt{3}", True), ("x^{2}", "x^2", False),
    ("a+b+c", "c+b+a", False), ("\\text{yes}", "yes", True), (None, "x", False),
])
def test_grade_answer(a, b, want):
    assert E.grade_answer(a, b) is want


def test_verified():
    assert [E.verified("so \\boxed{\\frac{1}{2}}", "$0.5$"), E.verified("x", "=="), E.verified("none", "3"), E.verified(None, None)] == [1.0, None, 0.0, None]
    assert E.correct("2\\pi", "6.28") and not E.correct("2\\pi", "6.3")


def test_nothing_is_executed_and_nesting_has_an_end():
    assert S.parse("__import__('os').getcwd()") is None and S.parse("(" * 20000 + "1" + ")" * 20000) is None
    assert E.latex_text("{" * 3000 + "a" + "}" * 3000) == "a"
    with pytest.raises(ValueError):
        E.latex_text("\\frac{1}{2")


def plain(text: str) -> str:
    """The reading by recursion on the first argument, for texts of letters, braces, fractions, roots and unknown words."""

    def group(at: int) -> tuple[str, int]:
        out = ""
        while at < len(text) and text[at] != "}":
            piece, at = one(at)
            out += piece
        return out, at

    def one(at: int) -> tuple[str, int]:
        if text[at] == "{":
            out, at = group(at + 1)
            return out, at + 1
        command = re.match(r"\\[a-z]+", text[at:])
        if not command:
            return text[at], at + 1
        at += len(command[0])
        if command[0] == "\\frac":
            a, at = one(at)
            b, at = one(at)
            return f" {a}/{b}", at
        if command[0] == "\\sqrt":
            a, at = one(at)
            return f"sqrt({a})", at
        return "", at

    return group(0)[0].strip()


def test_latex_text_by_recursion():
    rnd = random.Random(5)

    def made(depth: int) -> str:
        kind = rnd.randrange(6) if depth else 5
        inner = lambda: "{" + "".join(made(depth - 1) for _ in range(rnd.randrange(1, 3))) + "}"
        return ["\\frac" + inner() + inner(), "\\sqrt" + inner(), "\\foo" + inner(), inner(), "\\sqrt" + inner(), rnd.choice("abc123+-")][kind] if depth else rnd.choice("abc123+-")

    deep = "".join(rnd.choice(["\\sqrt{", "\\frac{1}{", "\\foo{"]) for _ in range(100)) + "x" + "}" * 100
    for text in [deep, *(made(rnd.randrange(1, 5)) for _ in range(300))]:
        assert E.latex_text(text) == plain(text), text


def test_expressions_against_floats():
    """Random rational expressions: equal after rewriting, different after a change."""
    rnd = random.Random(7)

    def made(depth: int) -> str:
        if not depth:
            return rnd.choice(["x", "y", "2", "3", "5"])
        return f"({made(depth - 1)}{rnd.choice('+-*')}{made(depth - 1)})"

    for _ in range(100):
        a, b, c = made(3), made(2), made(2)
        assert S.expressions_equal(f"{a}*({b}+{c})", f"{a}*{b}+{a}*{c}") and not S.expressions_equal(a, f"{a}+1")
        at = {"x": rnd.random(), "y": rnd.random()}
        want = eval(a, {}, at)  # noqa: S307  an expression made above
        got = S.value(re.sub("[xy]", lambda m: f"({at[m[0]]:.17f})", a))
        assert math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)
