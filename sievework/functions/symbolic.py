"""Mathematical expressions, plain or in LaTeX, as trees, and whether two of them are equal.

Equality is decided by evaluation at seeded points. Expressions of + - * / and integer powers are evaluated modulo two
primes near 2^61, where two different ones agree at a random point with a chance of their degree over 2^61. Roots, other
powers and functions are evaluated at complex points, where principal values tell sqrt(x^2) from x. A point at which
either side isn't defined is passed over. No algebra system is needed, and no text is ever executed."""

from __future__ import annotations

import cmath
import functools
import hashlib
import math
import re
from fractions import Fraction

PRIMES = (2305843009213693951, 2305843009213693921)
POINTS, TRIES, TOLERANCE = 4, 16, 1e-9
#: Integer exponents beyond this are evaluated as floats.
EXPONENT = 1 << 20
TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?|\.\d+)|(\\[a-zA-Z]+|\\.)|([a-zA-Z]+)|(\*\*|.))", re.S)
FUNCTIONS = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan,
    "asin": cmath.asin, "acos": cmath.acos, "atan": cmath.atan, "exp": cmath.exp, "ln": cmath.log, "log": cmath.log, "sqrt": cmath.sqrt, "abs": lambda z: complex(abs(z)),
    "cot": lambda z: 1 / cmath.tan(z), "sec": lambda z: 1 / cmath.cos(z), "csc": lambda z: 1 / cmath.sin(z),
}
CONSTANTS = {"pi": cmath.pi + 0j, "E": cmath.e + 0j, "I": 1j}
OPERATORS = {"\\cdot": "*", "\\times": "*", "\\ast": "*", "\\div": "/", "\\left": "", "\\right": "", "\\,": "", "\\!": "", "\\;": "", "\\:": "", "\\ ": "", "\\quad": "", "**": "^", "\\{": "(", "\\}": ")"}
CLOSING = {"(": ")", "{": "}", "[": "]"}


class Unreadable(ValueError):
    """The text isn't an expression."""


class Undefined(ArithmeticError):
    """No value at this point."""


class NotRational(ArithmeticError):
    """More than field operations."""


#: Results that a worker remembers of a function, and characters of arguments up to which it does.
REMEMBERED, LONGEST = 1 << 15, 1000


def remembered(f):
    """``f`` of texts, which answers that many rows share are put to once. Long texts are not kept."""
    kept = functools.lru_cache(REMEMBERED)(f)

    @functools.wraps(f)
    def call(*args, **more):
        return (kept if sum(len(x) for x in args if isinstance(x, str)) <= LONGEST else f)(*args, **more)

    return call


def tokens(text: str) -> list[str]:
    out = []
    for number, command, letters, other in TOKEN.findall(text.strip()):
        if command in OPERATORS or other in OPERATORS:
            out += [OPERATORS[command or other]] if OPERATORS[command or other] else []
        elif command in ("\\dfrac", "\\tfrac", "\\cfrac"):
            out.append("\\frac")
        elif command.lstrip("\\") in FUNCTIONS or command == "\\pi":
            out.append("\\sqrt" if command == "\\sqrt" else command[1:])
        elif letters:  # known names, else a letter each
            while letters:
                known = next((n for k in range(len(letters), 0, -1) if (n := letters[:k]) in FUNCTIONS or n in CONSTANTS or n in ("inf", "oo")), letters[0])
                out.append(known)
                letters = letters[len(known) :]
        elif number or command or other.strip():
            out.append(number or command or other)
    return out


class _Reader:
    """Recursive descent over tokens; a product's sign may be left out, a power binds to the right."""

    def __init__(self, found: list[str]):
        self.found = found[::-1]

    def peek(self) -> str:
        return self.found[-1] if self.found else ""

    def take(self, want: str | None = None) -> str:
        if not self.found or want is not None and self.found[-1] != want:
            raise Unreadable(want or "more")
        return self.found.pop()

    def sum(self) -> tuple:
        out = self.product()
        while self.peek() in ("+", "-"):
            sign = self.take()
            out = (sign, out, self.product())
        return out

    def begins_factor(self) -> bool:
        t = self.peek()
        return bool(t) and (t[0].isalnum() or t[0] == "." or t in CLOSING or t[0] == "\\" and t not in ("\\\\", "\\%"))

    def product(self) -> tuple:
        out = self.signed()
        while True:
            if self.peek() in ("*", "/"):
                sign = self.take()
                out = (sign, out, self.signed())
            elif self.begins_factor():
                out = ("*", out, self.power())
            else:
                return out

    def signed(self) -> tuple:
        if self.peek() in ("+", "-"):
            return ("-", ("n", Fraction(0)), self.signed()) if self.take() == "-" else self.signed()
        return self.power()

    def power(self) -> tuple:
        base = self.atom()
        while self.peek() == "!":
            self.take()
            base = ("!", base)
        if self.peek() == "^":
            self.take()
            return ("^", base, self.signed())
        return base

    def argument(self) -> tuple:
        """A command's argument: a group, or one digit or letter."""
        t = self.peek()
        if t[:1].isdigit() and len(t) > 1:
            self.found[-1] = t[1:]
            return ("n", Fraction(t[0]))
        return self.atom()

    def atom(self) -> tuple:
        t = self.take()
        if t in CLOSING:
            inner = self.sum()
            self.take(CLOSING[t])
            return inner
        if t == "|":
            inner = self.sum()
            self.take("|")
            return ("f", "abs", inner)
        if t == "\\frac":
            return ("/", self.argument(), self.argument())
        if t == "\\sqrt":
            if self.peek() != "[":
                return ("f", "sqrt", self.argument())
            self.take()
            root = self.sum()
            self.take("]")
            return ("^", self.argument(), ("/", ("n", Fraction(1)), root))
        if t in FUNCTIONS:
            raised = None
            if self.peek() == "^":
                self.take()
                raised = self.argument()
            out = ("f", t, self.power())
            return ("^", out, raised) if raised else out
        if t in CONSTANTS:
            return ("c", t)
        if t[0].isdigit() or t[0] == ".":
            return ("n", Fraction(t if t[-1] != "." else t[:-1]))
        if t[0].isalpha() or t[0] == "\\" and t[1:].isalpha() and t not in ("\\text", "\\mathrm", "\\begin", "\\end"):
            if self.peek() == "_":
                self.take()
                t += f"_{self.argument()}"
            return ("v", t)
        raise Unreadable(t)


@remembered
def parse(text: str) -> tuple | None:
    """The tree of an expression, null for anything else."""
    try:
        reader = _Reader(tokens(text))
        tree = reader.sum()
        return tree if not reader.found else None
    except (Unreadable, RecursionError, ZeroDivisionError):
        return None


def variables(tree: tuple) -> set[str]:
    return {tree[1]} if tree[0] == "v" else set().union(*(variables(x) for x in tree[1:] if isinstance(x, tuple)), set())


def _seeded(name: str, point: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{point}:{name}".encode(), digest_size=8).digest(), "big")


def constant(tree: tuple) -> Fraction:
    """The exact value of a tree of numbers and field operations."""
    kind = tree[0]
    if kind == "n":
        return tree[1]
    if kind in "+-*/" and len(tree) == 3:
        a, b = constant(tree[1]), constant(tree[2])
        if kind == "/" and not b:
            raise Undefined
        return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b
    if kind == "^":
        a, b = constant(tree[1]), constant(tree[2])
        if b.denominator == 1 and abs(b) <= 64 and (a or b > 0):
            return a**b.numerator
    raise NotRational


def modular(tree: tuple, prime: int, point: int) -> int:
    """The value of a rational expression at a point of the field of ``prime`` elements."""
    kind = tree[0]
    if kind == "n":
        if tree[1].denominator % prime == 0:
            raise Undefined
        return tree[1].numerator * pow(tree[1].denominator, -1, prime) % prime
    if kind == "v":
        return _seeded(tree[1], point) % prime
    if kind == "^":
        raised = constant(tree[2])
        if raised.denominator != 1 or abs(raised) > EXPONENT:
            raise NotRational
        base = modular(tree[1], prime, point)
        if not base and raised <= 0:
            raise Undefined
        return pow(base, int(raised), prime)
    if kind not in "+-*/":
        raise NotRational
    a, b = modular(tree[1], prime, point), modular(tree[2], prime, point)
    if kind == "/":
        if not b:
            raise Undefined
        return a * pow(b, -1, prime) % prime
    return (a + b if kind == "+" else a - b if kind == "-" else a * b) % prime


def numeric(tree: tuple, point: int) -> complex:
    """The value at a complex point near the unit circle; points turn by the golden angle, so that every half plane is met."""
    kind = tree[0]
    if kind == "n":
        return complex(tree[1])
    if kind == "c":
        return CONSTANTS[tree[1]]
    if kind == "v":
        return cmath.rect(0.5 + _seeded(tree[1], point) % 1009 / 1009, 2.4 * point + _seeded(tree[1], 0) % 1013 / 1013)
    if kind == "f":
        return FUNCTIONS[tree[1]](numeric(tree[2], point))
    a = numeric(tree[1], point)
    if kind == "!":
        if abs(a.imag) > TOLERANCE or abs(a.real - round(a.real)) > TOLERANCE or not 0 <= a.real <= 170:
            raise Undefined
        return complex(math.factorial(round(a.real)))
    b = numeric(tree[2], point)
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b if kind == "/" else a**b


def trees_equal(a: tuple, b: tuple) -> bool:
    try:
        difference, agreed = ("-", a, b), 0
        for point in range(TRIES):
            try:
                if any(modular(difference, p, point) for p in PRIMES):
                    return False
                agreed += 1
            except Undefined:
                continue
            if agreed == POINTS:
                return True
        return False
    except NotRational:
        pass
    agreed = 0
    for point in range(TRIES):
        try:
            x, y = numeric(a, point), numeric(b, point)
        except (ArithmeticError, ValueError):
            continue
        if not (cmath.isfinite(x) and cmath.isfinite(y)):
            continue
        if abs(x - y) > TOLERANCE * max(1e-3, abs(x), abs(y)):
            return False
        agreed += 1
        if agreed == POINTS:
            return True
    return False


def expressions_equal(a: str, b: str) -> bool:
    p, q = parse(a), parse(b)
    try:
        return p is not None and q is not None and trees_equal(p, q)
    except RecursionError:
        return False


def value(text: str) -> float | None:
    """The real value of an expression without variables."""
    tree = parse(text)
    try:
        if tree is None or variables(tree):
            return None
        x = numeric(tree, 0)
    except (ArithmeticError, ValueError, RecursionError):
        return None
    return x.real if abs(x.imag) <= TOLERANCE * max(1.0, abs(x)) and math.isfinite(x.real) else None
