"""Answers found by the words around them, and answers as plain expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that an answer follows, words that it precedes, and those that the last part of a sentence follows.
LEADS = ["answer:", "answer is", "answers are"]
TRAILS = ["is answer", "is the answer", "are answers", "are the answers"]
VERBS = ["be ", "is ", "are ", "=", ": ", "get ", "be\n", "is\n", "are\n", ":\n", "get\n"]
# Units that carry no meaning, in the order in which they are taken out.
UNITS = ["degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard", "liter"]
# Signs and words of plain answers, with what stands for them, in the order of their replacement.
WORDINGS = [("\\%", "%"), ("\\$", "$"), ("$", ""), ("%", ""), (" or ", " , "), (" and ", " , "), ("million", "*10^6"), ("billion", "*10^9"), ("trillion", "*10^12")]
# Plain forms of LaTeX symbols.
SYMBOLS = [("\\pi", "pi"), ("\\infty", "inf"), ("\\cup", "U"), ("\\cdot", "*"), ("\\times", "*")]

FLOAT = r"\A\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def _from_end(text: Column, mark: Column) -> Column:
    """Characters behind the last occurrence of ``mark``, whatever the case of A to Z, plus 1; 0 where there is none."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.position(F.reverse(mark), F.reverse(low))


def _cut(state: Column, marks: list[tuple[str, bool]], counts: bool) -> Column:
    """The state (matched, text) once each mark has cut the text: to what follows it last (True) or to what precedes it
    (False); ``counts`` says whether a cut is a match."""
    steps = F.array(*(F.struct(F.lit(m).alias("mark"), F.lit(after).alias("after")) for m, after in marks))

    def step(s: Column, m: Column) -> Column:
        def cut(at: Column) -> Column:
            rest = F.when(m["after"], F.right(s["text"], at - 1)).otherwise(F.left(s["text"], F.length(s["text"]) - at + 1 - F.length(m["mark"])))
            return F.when(at > 0, F.struct((s["matched"] | F.lit(counts)).alias("matched"), stripped(rest).alias("text"))).otherwise(s)

        return bound(_from_end(s["text"], m["mark"]), cut)

    return F.aggregate(steps, state, step)


def _box(text: Column) -> Column:
    """What the braces after the last ``\\boxed``, or without one the last ``\\fbox``, hold; null without a balanced pair."""

    def inside(tail: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            at, depth = s["at"] + 1, s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
            first = F.when((s["first"] == 0) & (c == "{"), at).otherwise(s["first"])
            last = F.when((s["last"] == 0) & (c == "}") & (depth == 0), at).otherwise(s["last"])
            return F.struct(at.alias("at"), depth.alias("depth"), first.alias("first"), last.alias("last"))

        start = F.struct(*(F.lit(0).alias(x) for x in ("at", "depth", "first", "last")))
        found = F.aggregate(F.split(tail, ""), start, step)
        return bound(found, lambda s: F.when((s["first"] > 0) & (s["last"] > 0), stripped(F.substring(tail, s["first"] + 1, s["last"] - s["first"] - 1))))

    has = lambda mark: F.contains(text, F.lit(mark))
    tail = F.when(has("\\boxed"), F.substring_index(text, "\\boxed", -1)).when(has("\\fbox"), F.substring_index(text, "\\fbox", -1))
    return F.when(tail.isNotNull(), bound(tail, inside))


def matched_answer(response: Column) -> Column:
    """matched and answer of a response: what follows or precedes the words around an answer, the last box, what
    precedes the last full stop, and what follows the last verb. An answer without a digit is no match; a null response
    is null. Only A to Z are lower-cased to find the words."""
    begun = _cut(F.struct(F.lit(False).alias("matched"), response.alias("text")), [*((m, True) for m in LEADS), *((m, False) for m in TRAILS)], True)

    def boxed(s: Column) -> Column:
        return bound(_box(s["text"]), lambda b: F.when(F.coalesce(b != "", F.lit(False)), F.struct(F.lit(True).alias("matched"), b.alias("text"))).otherwise(s))

    ended = _cut(_cut(bound(begun, boxed), [(". ", False)], False), [(m, True) for m in VERBS], True)
    digit = r"[\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089]"
    return F.when(response.isNotNull(), bound(ended, lambda s: F.struct((s["matched"] & s["text"].rlike(digit)).alias("matched"), s["text"].alias("answer"))))


def _whole(text: Column, otherwise: Column) -> Column:
    """``text`` as an integer where it is a number within 1e-7 of one."""
    x = F.when(text.rlike(FLOAT), F.trim(text).cast("double"))
    return F.when(F.abs(x - F.round(x)) <= 1e-7, F.coalesce(F.round(x).cast("decimal(38,0)").cast("string"), otherwise)).otherwise(otherwise)


def plain_answer(answer: Column) -> Column:
    """An answer without units, dollar and per cent signs, in lower case, with LaTeX fractions, roots and SYMBOLS as
    plain text, mixed numbers as sums and whole numbers as integers. Of LaTeX, fractions and roots up to three levels
    deep are read; other commands stay as they are. Null stays null."""
    out = F.regexp_replace(answer, r"^\\text\{(.+?)\}$", "$1")
    for old, new in WORDINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    for unit in UNITS:
        out = F.regexp_replace(out, rf"{unit}(es)?(s)? *(\^[0-9]+)?", "")
    out = F.regexp_replace(out, r"\^ *\\circ", "")
    out = F.regexp_replace(out, r"(?s)\A\{(.*)\}\z", "$1")
    out = F.regexp_replace(out, r",\\! *", "")

    def plain(x: Column) -> Column:
        y = F.regexp_replace(x, r" ?\\[td]?frac", r" \\frac")
        for _ in range(3):
            y = F.regexp_replace(F.regexp_replace(y, r"\\sqrt\{([^{}]*)\}", "sqrt($1)"), r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1/$2")
        for old, new in SYMBOLS:
            y = F.replace(y, F.lit(old), F.lit(new))
        y = F.when(F.contains(x, F.lit("\\")), F.trim(y)).otherwise(x)
        return F.lower(F.regexp_replace(F.regexp_replace(y, "- *", "-"), "([0-9]) +([0-9])", "$1+$2"))

    def number(x: Column) -> Column:
        bare = x
        for _ in range(3):  # a third pass changes nothing more
            bare = F.regexp_replace(bare, r"([0-9]),([0-9]{3})($|[^0-9])", "$1$2$3")
        return bound(bare, lambda b: _whole(b, x))

    return bound(bound(bound(out, lambda x: _whole(x, x)), plain), number)
