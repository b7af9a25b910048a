"""Left folds over arrays that emit a value an element, in time that follows the array's length.

A fold that grows an array copies it for each element; here it grows an array for a block of elements and an array of blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .spans import FOLDED
from .text import col, let


def emitted(items, state: str, start: Column, step, emit, kind: str = "int") -> Column:
    """array<kind>: emit(state) after each element of items; step(state, element) gives the next state, of type `state`."""
    outer, inner = f"struct<s:{state},out:array<array<{kind}>>>", f"struct<s:{state},out:array<{kind}>>"
    none = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        return let(step(acc["s"], x).cast(state), lambda s: F.struct(s.alias("s"), F.concat(acc["out"], F.array(emit(s).cast(kind))).alias("out")).cast(inner))

    def block(acc, xs):
        done = F.aggregate(xs, F.struct(acc["s"].alias("s"), none.alias("out")).cast(inner), one)
        return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["out"], F.array(d["out"])).alias("out")).cast(outer))

    def whole(xs):
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(xs) - 1, F.lit(0)) / FOLDED).cast("int")), lambda k: F.slice(xs, (k * FOLDED + 1).cast("int"), FOLDED))
        return F.aggregate(runs, F.struct(start.cast(state).alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")).cast(outer), block, lambda acc: F.flatten(acc["out"]))

    return let(col(items), whole)


def grouped(items, numbers) -> Column:
    """array<array<item>>: runs of items with one group number; numbers never fall."""

    def runs(xs, ns):
        begins = F.filter(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0))), lambda i: (F.size(xs) > 0) & ((i == 0) | (F.get(ns, i) != F.get(ns, i - 1))))
        return let(begins, lambda bs: F.transform(bs, lambda b, k: F.slice(xs, b + 1, F.coalesce(F.get(bs, k + 1), F.size(xs)) - b)))

    return let(col(items), lambda xs: let(col(numbers), lambda ns: runs(xs, ns)))
