"""Numbered lines of a text and their parts, over Arrow batches: each is read on from where the last one ended, so a row costs
what its text is long. Interpreted folds over arrays cost some hundred times that a line.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import lexicon as L
from .text import col

_END = re.compile(L.SENTENCE_END)


def lines_of(text: str, most: int) -> list[tuple[int, str]]:
    """(start, line) of the lines that are not blank; one of more than `most` characters is cut at the first sentence end at or
    after them, and again."""
    found, at = [], 0
    for raw in text.split("\n"):
        line = raw.strip(L.WHITE_SPACE)
        if line:
            start = at + len(raw) - len(raw.lstrip(L.WHITE_SPACE))
            begin = 0
            if len(line) > most:
                for end in (m.end() for m in _END.finditer(line)):
                    if end - begin >= most:
                        found.append((start + begin, line[begin:end]))
                        begin = end
            if begin < len(line):
                found.append((start + begin, line[begin:]))
        at += len(raw) + 1
    return found


def parts_of(sizes, most_chars: int, most_lines: int) -> list[int]:
    """The part of each line: lines fill a part until it has most_lines or would pass most_chars."""
    parts, part, n, filled = [], 0, 0, 0
    for size in sizes:
        if n and (n >= most_lines or filled + size > most_chars):
            part, n, filled = part + 1, 0, 0
        n, filled = n + 1, filled + size
        parts.append(part)
    return parts


def slices_of(text: str, most: int, most_chars: int, most_lines: int) -> list[tuple[int, int, str, str]]:
    """(first line, last line, text from the first to the last, the lines as they are shown) of each part."""
    lines = lines_of(text, most)
    parts = parts_of([len(line) for _, line in lines], most_chars, most_lines)
    begins = [i for i, p in enumerate(parts) if i == 0 or p != parts[i - 1]]
    cut = []
    for a, b in zip(begins, [*begins[1:], len(lines)]):
        whole = text[lines[a][0] : lines[b - 1][0] + len(lines[b - 1][1])]
        cut.append((a + 1, b, whole.strip(L.WHITE_SPACE), "\n".join(f"L{i + 1}: {lines[i][1]}" for i in range(a, b))))
    return cut


def reworded(text: str, lines: list[dict], rows: list[dict]) -> str:
    """The text with each line (start, end) as the first of the rows (a, b, new) over it has it, or as it is."""
    new = [None] * len(lines)
    for row in reversed(rows):
        if row["a"] is not None and row["b"] is not None:
            a, b = max(row["a"], 1), min(row["b"], len(lines))
            if a <= b:
                new[a - 1 : b] = [row["new"]] * (b - a + 1)
    done, at = [], 0
    for line, swap in zip(lines, new):
        done += text[at : line["start"]], text[line["start"] : line["end"]] if swap is None else swap
        at = line["end"]
    return "".join(done) + text[at:]


def _lists(texts: pa.Array, work, fields: dict) -> pa.Array:
    """work(text) of each row, a list of tuples, as a list of structs; null where the text is."""
    ends, values = [0], [[] for _ in fields]
    for text in texts:
        for row in work(text.as_py()) if text.is_valid else ():
            for held, value in zip(values, row):
                held.append(value)
        ends.append(len(values[0]))
    structs = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(values, fields.values())], list(fields))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, mask=texts.is_null() if texts.null_count else None)


def line_array(text, most: int = 160) -> Column:
    """array<struct<start, text>>: lines_of() a text column."""

    @F.arrow_udf("array<struct<start:int,text:string>>")
    def found(texts: pa.Array) -> pa.Array:
        return _lists(texts, lambda t: lines_of(t, most), {"start": pa.int32(), "text": pa.string()})

    return found(col(text))


def slice_array(text, most_chars: int, most_lines: int, most: int = 160) -> Column:
    """array<struct<first, last, content, shown>>: slices_of() a text column."""

    @F.arrow_udf("array<struct<first:int,last:int,content:string,shown:string>>")
    def found(texts: pa.Array) -> pa.Array:
        return _lists(texts, lambda t: slices_of(t, most, most_chars, most_lines), {"first": pa.int32(), "last": pa.int32(), "content": pa.string(), "shown": pa.string()})

    return found(col(text))


def part_array(sizes, most_chars: int, most_lines: int) -> Column:
    """array<int>: parts_of() a column of sizes."""

    @F.arrow_udf("array<int>")
    def found(rows: pa.Array) -> pa.Array:
        return pa.array([None if row is None else parts_of(row, most_chars, most_lines) for row in rows.to_pylist()], pa.list_(pa.int32()))

    return found(col(sizes))


def rewritten(text, lines, rows) -> Column:
    """reworded() a text column; null where anything is."""

    @F.arrow_udf("string")
    def found(texts: pa.Array, lines: pa.Array, rows: pa.Array) -> pa.Array:
        each = zip(texts.to_pylist(), lines.to_pylist(), rows.to_pylist())
        return pa.array([None if t is None or ls is None or rs is None else reworded(t, ls, rs) for t, ls, rs in each], pa.string())

    return found(col(text), col(lines), col(rows))
