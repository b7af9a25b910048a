"""Offsets of regex matches, and pieces of a text, as columns whose cost follows the length of the text.

Spark's functions return matches without offsets. Matches and the gaps between them alternate, so running lengths give the
offsets: start_i = sum of the gaps up to i and of the matches before i. Valid for patterns that cannot match empty. All
happens in the row: no explode, no shuffle.

Growing an array element by element copies it each time, and cutting a piece out of a text scans the text from its start.
Both are kept to blocks here, so a book costs what its chapters would cost.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, let

#: Elements that one fold may grow, and characters of a block of text.
FOLDED, BLOCK = 256, 4096


def running(values, step, start=0) -> Column:
    """array<int>: after each element, `step` of all elements so far. step must be associative, with `start` neutral."""
    zero = F.lit(start)

    def grown(items):
        return F.aggregate(items, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(step(F.coalesce(F.try_element_at(acc, F.lit(-1)), zero), x).cast("int"))))

    def whole(items):
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / FOLDED).cast("int")), lambda k: grown(F.slice(items, (k * FOLDED + 1).cast("int"), FOLDED)))
        return let(runs, lambda rs: let(grown(F.transform(rs, lambda r: F.coalesce(F.try_element_at(r, F.lit(-1)), zero))), lambda last: F.flatten(F.transform(rs, lambda r, k: F.transform(r, lambda x: step(x, F.coalesce(F.get(last, k - 1), zero)).cast("int"))))))

    return let(col(values), whole)


def spans(text, pattern) -> Column:
    """array<struct<start:int, end:int, raw:string>>, 0-based, ends exclusive, in order. The pattern is text or a column."""
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)

    def found(t):
        def placed(raws):
            sizes = F.zip_with(F.slice(F.split(t, pattern, -1), F.lit(1), F.size(raws)), raws, lambda g, m: F.length(g) + F.length(m))
            return F.zip_with(running(sizes, lambda a, b: a + b), raws, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("raw")))

        return let(F.regexp_extract_all(t, pattern, F.lit(0)), placed)

    return let(col(text), found)


def piece(text, start, end) -> Column:
    """text[start:end] with 0-based bounds; for many pieces of one text, cut() out of blocks()."""
    return F.substring(col(text), col(start) + 1, F.greatest(col(end) - col(start), F.lit(0)))


def blocks(text) -> Column:
    """The text in runs of BLOCK characters."""
    return F.regexp_extract_all(col(text), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(parts, start, end) -> Column:
    """text[start:end] out of blocks(text), with 0-based bounds; only the blocks that it lies in are read."""
    first = F.floor(col(start) / BLOCK).cast("int")
    near = F.slice(col(parts), first + 1, F.greatest(F.ceil(col(end) / BLOCK).cast("int") - first, F.lit(0)))
    return F.substring(F.array_join(near, ""), col(start) - first * BLOCK + 1, F.greatest(col(end) - col(start), F.lit(0)))
