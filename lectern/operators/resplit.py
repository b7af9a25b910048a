"""Chunk analysis over a table of recorded calls: what failed is cut smaller, by the kind of failure, until all lines are settled.

A chunk's lines and its calls meet in one row. The queue is a list of line ranges: an open range is looked up among the calls,
stays if its reply could be read, is cut if it failed and can be cut, and is given up otherwise. Each kind of failure has its own
limits, all of them ordered, and a range cut by some limits is cut again by narrower ones only; so the work ends. A range is found
by its key, so a chunk costs what its lines and calls are. Replies are decoded for the ranges that stay, in their row.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.lines import parts_of
from .codecs import readable_rows, segments_of
from .service import failure_kinds

#: Why lines were given up, by kind of failure.
REASONS = {"filter": "content_filter", "length": "finish_reason_length", "decode": "compact_decode_failed"}
PIECE = "struct<first:int,last:int,title:string,kind:string,call:int>"
EVENT = "struct<event:string,title:string,first:int,last:int,parts:int>"


def limits(kind: str, budget: int, most_lines: int) -> tuple[int, int]:
    """Characters and lines of the parts that a range is cut into after a failure."""
    return {"timeout": (max(800, budget - 200), max(24, most_lines - 12)), "decode": (max(500, budget // 2), max(8, most_lines // 2)), "length": (320, 6), "filter": (320, 1)}[kind]


def outcomes(calls: DataFrame) -> DataFrame:
    """calls (doc_id, chunk_idx, first, last, response, error) -> key, kind (null: readable), detail and response, a row a call."""
    read = F.col("error").isNull() & (F.size(readable_rows("response", F.col("last") - F.col("first") + 1)) > 0)
    told = F.when(F.col("error").isNotNull(), failure_kinds("error")).otherwise("decode")
    kind = F.when(~F.coalesce(read, F.lit(False)), F.when(told == "transient", "decode").otherwise(told))
    return calls.select("doc_id", "chunk_idx", "first", "last", kind.alias("kind"), F.coalesce("error", F.lit("empty compact reply")).alias("detail"), "response")


def worked_off(sizes: list[int], shown: int, title: str, asked, budget: int, most_lines: int) -> tuple[list[dict], list[dict]]:
    """Settled ranges, in order, and events of a chunk: asked(first, last) gives the kind (None: readable) and number of a call."""
    by = {kind: limits(kind, budget, most_lines) for kind in ("timeout", "decode", "length", "filter")}

    def parts(first, last, name, chars, count):
        numbers = parts_of(sizes[first - 1 : last], chars, count)
        begins = [first + i for i, part in enumerate(numbers) if i == 0 or part != numbers[i - 1]]
        return [(a, b - 1, f"{name}（第{i}部分）") for i, (a, b) in enumerate(zip(begins, [*begins[1:], last + 1]), 1)]

    open_, pieces, events = [(1, len(sizes), title)], [], []
    if len(sizes) > most_lines or shown > 2 * budget:
        open_ = parts(*open_[0], budget, most_lines)[::-1]
        open_ = open_ if len(open_) > 1 else [(1, len(sizes), title)]
    while open_:
        first, last, name = piece = open_.pop()
        kind, call = asked(first, last)
        if kind:
            cut = parts(*piece, *by[kind])
            # what a timeout leaves whole is cut as an unreadable reply
            if kind == "timeout" and len(cut) < 2:
                kind, cut = "decode", parts(*piece, *by["decode"])
            label, split = "content_filter" if kind == "filter" else kind, len(cut) > 1
            events.append({"event": label + ("_split" if split else "_skip"), "title": name, "first": first, "last": last, "parts": len(cut) if split else 0})
            if split:
                open_.extend(cut[::-1])
                continue
        pieces.append({"first": first, "last": last, "title": name, "kind": kind, "call": call})
    return pieces, events


def _queue(budget: int, most_lines: int) -> Column:
    """struct<pieces, events>: worked_off() a chunk's row (sizes, shown, title, calls); a call is found by its range, of several
    the last counts."""

    @F.arrow_udf(f"struct<pieces:array<{PIECE}>,events:array<{EVENT}>>")
    def found(sizes: pa.Array, shown: pa.Array, titles: pa.Array, first: pa.Array, last: pa.Array, kinds: pa.Array) -> pa.Array:
        ends = first.flatten().to_numpy(zero_copy_only=False).astype("int64") << 32 | last.flatten().to_numpy(zero_copy_only=False)
        kinds, at, rows = kinds.flatten(), 0, []
        for ss, chars, title, n in zip(sizes, shown.to_pylist(), titles.to_pylist(), pc.list_value_length(first).to_pylist()):
            place = dict(zip(ends[at : at + n].tolist(), range(n)))

            def asked(a, b):
                call = place.get(a << 32 | b)
                return ("decode", None) if call is None else (kinds[at + call].as_py(), call)

            pieces, events = worked_off(ss.as_py(), chars, title or "", asked, budget, most_lines)
            rows.append({"pieces": pieces, "events": events})
            at += n
        shape = lambda **fields: pa.list_(pa.struct(fields))
        piece = shape(first=pa.int32(), last=pa.int32(), title=pa.string(), kind=pa.string(), call=pa.int32())
        event = shape(event=pa.string(), title=pa.string(), first=pa.int32(), last=pa.int32(), parts=pa.int32())
        return pa.array(rows, pa.struct({"pieces": piece, "events": event}))

    return found("sizes", "shown", "title", "calls.first", "calls.last", "calls.kind")


def _worked_off(lines: DataFrame, calls: DataFrame, budget: int, most_lines: int) -> DataFrame:
    """doc_id, chunk_idx, ls, calls, q (the chunk's _queue()). Of several calls for a range a readable one counts, else the one
    whose failure sorts last."""
    key = ["doc_id", "chunk_idx"]
    titled = lines if "title" in lines.columns else lines.withColumn("title", F.lit(""))
    rows = titled.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("line_no", "line_id", "text"))).alias("ls"), F.max("title").alias("title"))
    call = F.struct("first", "last", F.col("kind").isNull().alias("read"), "kind", "detail", "response")
    said = calls.where("first is not null and last is not null").groupBy(*key).agg(F.sort_array(F.collect_list(call)).alias("calls"))
    none = F.array().cast("array<struct<first:int,last:int,read:boolean,kind:string,detail:string,response:string>>")
    # calls outgrow by far what the input's size lets Spark expect: never to be broadcast
    chunks = rows.join(said.hint("merge"), key, "left").withColumn("calls", F.coalesce("calls", none))
    size = F.transform("ls", lambda x: F.greatest(F.lit(1), F.length(x["text"])))
    shown = F.aggregate("ls", F.lit(-1), lambda a, x: a + F.length(x["line_id"]) + 2 + F.length(x["text"]) + 1)
    return chunks.withColumns({"sizes": size, "shown": shown}).select(*key, "ls", "calls", _queue(budget, most_lines).alias("q"))


def _placed(piece: Column) -> Column:
    """struct<first, last, title, settled, reason, detail> of a settled range, out of its chunk's calls."""
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[piece["kind"]]
    detail = F.when(piece["kind"].isNotNull(), F.coalesce(F.get("calls", piece["call"])["detail"], F.lit("no reply")))
    return F.struct(piece["first"].alias("first"), piece["last"].alias("last"), piece["title"].alias("title"), F.lit(True).alias("settled"), reason.alias("reason"), detail.alias("detail"))


def settled_pieces(lines: DataFrame, calls: DataFrame, budget: int = 1200, most_lines: int = 48) -> DataFrame:
    """lines (doc_id, chunk_idx, title, line_no, line_id, text) and outcomes() -> doc_id, chunk_idx, pieces, events: all lines in
    settled ranges, in order, and what was cut or given up on the way."""
    return _worked_off(lines, calls, budget, most_lines).select("doc_id", "chunk_idx", F.transform("q.pieces", _placed).alias("pieces"), "q.events")


def analyse_recorded(lines: DataFrame, calls: DataFrame, budget: int = 1200, most_lines: int = 48) -> DataFrame:
    """lines (doc_id, chunk_idx, line_no, line_id, text and, if present, title) and recorded calls -> doc_id, chunk_idx, seq,
    speaker, style, emotion, confidence_label, text, line_id, needs_review, skip_reason, source_title, evidence.

    Calls are (doc_id, chunk_idx, first, last, response, error), a row for a range of a chunk's lines; a range without a call
    counts as unreadable. Lines that are given up stay as UNKNOWN rows that say why, so no text is lost.
    """
    # a range takes its own lines and reply along, not those of the chunk
    own = lambda p: F.struct(_placed(p).alias("p"), F.slice("ls", p["first"], p["last"] - p["first"] + 1).alias("ls"), F.when(p["kind"].isNull(), F.get("calls", p["call"])["response"]).alias("response"))
    pieces = _worked_off(lines, outcomes(calls), budget, most_lines).select("doc_id", "chunk_idx", F.explode(F.transform("q.pieces", own)).alias("x")).select("doc_id", "chunk_idx", "x.*")
    fields = ("speaker", "style", "emotion", "confidence_label", "text", "line_id")
    none = F.lit(None).cast("string")
    read = F.transform(segments_of("response", "ls"), lambda s: F.struct(*[s[c].alias(c) for c in fields], F.lit(False).alias("needs_review"), *[none.alias(c) for c in ("skip_reason", "source_title", "evidence")]))
    why = lambda line_id: F.concat("p.title", F.lit(" "), line_id, F.lit(" 触发 "), "p.reason", F.lit("，已保留原文并跳过 LLM 角色归属。"), "p.detail")
    given = lambda l: (F.lit("UNKNOWN"), F.lit("female, moderate pitch"), F.lit("neutral"), F.lit("low"), l["text"], l["line_id"])
    left = F.transform("ls", lambda l: F.struct(*[v.alias(c) for c, v in zip(fields, given(l))], F.lit(True).alias("needs_review"), F.col("p.reason").alias("skip_reason"), F.col("p.title").alias("source_title"), why(l["line_id"]).alias("evidence")))
    rows = pieces.select("doc_id", "chunk_idx", "p.first", F.posexplode(F.when(F.col("p.reason").isNull(), read).otherwise(left)).alias("pos", "s"))
    seq = F.row_number().over(Window.partitionBy("doc_id", "chunk_idx").orderBy("first", "pos"))
    return rows.select("doc_id", "chunk_idx", seq.alias("seq"), "s.*")


def resplit_events(lines: DataFrame, calls: DataFrame, budget: int = 1200, most_lines: int = 48) -> DataFrame:
    """doc_id, chunk_idx, event, title, first, last, parts: every cut and every range given up."""
    # a bare explode of q.events would be given a filter below the queue, which then runs twice
    return _worked_off(lines, outcomes(calls), budget, most_lines).select("doc_id", "chunk_idx", F.explode(F.transform("q.events", lambda e: e)).alias("e")).select("doc_id", "chunk_idx", "e.*")
