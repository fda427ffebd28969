"""Random arithmetic from a grammar, drawn by hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.arrays import let
from sievework.operators.metrics import hashed_unit

#: What an operator makes of the value so far and the next term; all bind alike, from the left.
MEANING = {"@": lambda a, b: 3 * a - 2 * b, "+": lambda a, b: a + b, "-": lambda a, b: a - b}


def random_expression(row: Column, operators: str = "@", terms: tuple[int, int] = (2, 5), numbers: tuple[int, int] = (1, 10), depth: int = 2, seed: int = 42) -> Column:
    """A struct of text and value (long) for each ``row``: between ``terms`` many terms joined by ``operators``, each
    term a number from the first of ``numbers`` up to below the second or, half the time and up to ``depth`` deep, an
    expression in brackets. Every choice is a hash of seed, row and place, so that rows are the same in every run."""
    if not set(operators) <= set(MEANING):
        raise ValueError(f"operators are {''.join(MEANING)}")

    def choice(what: str, place: Column, low: int, high: int) -> Column:
        return (F.lit(low) + F.floor(hashed_unit(F.lit(seed), row, F.lit(what), place) * (high - low))).cast("long")

    def term(place: Column, left: int) -> Column:
        plain = let(choice("number", place, *numbers), lambda n: F.struct(n.cast("string").alias("text"), n.alias("value")))
        if not left:
            return plain
        inner = let(expression(place, left - 1), lambda e: F.struct(F.concat(F.lit("("), e["text"], F.lit(")")).alias("text"), e["value"].alias("value")))
        return F.when(choice("nested", place, 0, 2) == 1, inner).otherwise(plain)

    def expression(place: Column, left: int) -> Column:
        def one(i: Column) -> Column:
            at = F.concat(place, F.lit("."), i.cast("string"))
            op = F.lit(operators)
            if len(operators) > 1:  # one needs no draw
                op = F.substring(op, (choice("operator", at, 0, len(operators)) + 1).cast("int"), F.lit(1))
            return let(term(at, left), lambda t: F.struct(op.alias("op"), t["text"].alias("text"), t["value"].alias("value")))

        def joined(parts: Column) -> Column:
            first, rest = parts[0], F.slice(parts, F.lit(2), F.size(parts))
            text = F.concat(first["text"], F.array_join(F.transform(rest, lambda t: F.concat(F.lit(" "), t["op"], F.lit(" "), t["text"])), ""))

            def step(so_far: Column, t: Column) -> Column:
                out = MEANING[operators[0]](so_far, t["value"])
                for op in operators[1:]:
                    out = F.when(t["op"] == op, MEANING[op](so_far, t["value"])).otherwise(out)
                return out

            return F.struct(text.alias("text"), F.aggregate(rest, first["value"], step).alias("value"))

        count = choice("terms", place, terms[0], terms[1] + 1)
        return let(F.transform(F.sequence(F.lit(1).cast("long"), count), one), joined)

    return expression(F.lit("r"), depth)
