"""Compact reply formats: segments, chunk plans, rewrites, alias groups, fixes and attributions, and prompts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ..functions import lexicon as L
from ..functions.folds import emitted
from ..functions.lines import rewritten
from ..functions.spans import blocks, cut, running, spans
from ..functions.text import col, let, strings, strip


def strip_thoughts(c) -> Column:
    """Without <think> blocks, an unclosed one included."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def rows_of(c, header: str) -> Column:
    """Stripped lines without blanks and without the header line."""
    return F.filter(F.transform(F.split(col(c), "\r\n|\n|\r", -1), strip), lambda r: (r != "") & ~F.startswith(r, F.lit(header)))


def _mapped(code: Column, codes: dict[str, str], default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), code), F.lit(default))


def decode_attributions(replies: DataFrame) -> DataFrame:
    """replies (batch_id, quote_ids, response) -> batch_id, quote_id, speaker, confidence, attribution_type, evidence.

    `n|speaker|confidence|type|evidence`; rows with fewer than four fields, without a number or out of range are skipped; of
    several answers to a place the last one counts.
    """
    answers = lambda row: F.struct(F.split(row, "\\|", -1).alias("p"), F.regexp_replace(F.regexp_extract(row, r"^[^|]*", 0), "[^0-9]", "").alias("n"))
    given = F.filter(F.transform(rows_of(strip_thoughts("response"), "#"), answers), lambda a: F.size(a["p"]) >= 4)
    last = lambda xs: F.filter(xs, lambda a, i: ~F.exists(F.slice(xs, i + 2, F.size(xs)), lambda later: later["n"].try_cast("int") == a["n"].try_cast("int")))
    parts = replies.select("batch_id", "quote_ids", F.explode(let(given, last)).alias("a")).select("batch_id", "quote_ids", "a.p")
    number = F.regexp_replace(F.col("p")[0], "[^0-9]", "").try_cast("int")
    given = strip(F.col("p")[2]).try_cast("double")
    confidence = F.least(F.greatest(F.when(given.isNull() | F.isnan(given), 0.5).otherwise(given), F.lit(0.0)), F.lit(1.0))
    out = parts.select("batch_id", F.try_element_at("quote_ids", F.when(number > 0, number)).alias("quote_id"), strip(F.col("p")[1]).alias("speaker"), confidence.alias("confidence"), _mapped(strip(F.col("p")[3]), L.TYPE_CODES, "implicit").alias("attribution_type"), F.coalesce(strip(F.try_element_at("p", F.lit(5))), F.lit("")).alias("evidence"))
    return out.where("quote_id is not null")


def decode_json_attributions(replies: DataFrame) -> DataFrame:
    """replies (batch_id, quote_ids, response that holds a JSON array of objects, see recover_array) -> as decode_attributions().

    An answer's id is a quote id, else a 1-based place, else part of the first id that contains it or lies in it.
    """
    item = "array<struct<id:string,speaker:string,confidence:double,attribution_type:string,evidence:string>>"
    rows = replies.select("batch_id", "quote_ids", F.explode(F.from_json(recover_array("response"), item)).alias("x")).where("x is not null")
    i = F.coalesce("x.id", F.lit(""))
    place = F.when(i.rlike(r"\A[0-9]+\z"), i.try_cast("int"))
    loose = F.try_element_at(F.filter("quote_ids", lambda q: F.contains(q, i) | F.contains(i, q)), F.lit(1))
    quote = F.when(F.array_contains("quote_ids", i), i).otherwise(F.coalesce(F.try_element_at("quote_ids", F.when(place > 0, place)), loose))
    confidence = F.least(F.greatest(F.coalesce("x.confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    out = rows.select("batch_id", quote.alias("quote_id"), strip(F.coalesce("x.speaker", F.lit(L.UNKNOWN))).alias("speaker"), confidence.alias("confidence"), _mapped(strip(F.coalesce("x.attribution_type", F.lit("implicit"))), L.TYPE_CODES, "implicit").alias("attribution_type"), strip(F.coalesce("x.evidence", F.lit(""))).alias("evidence"))
    return out.where("quote_id is not null")


def decode_alias_groups(replies: DataFrame) -> DataFrame:
    """`canonical | alias, alias` -> doc_id, canonical, alias."""
    rows = replies.select("doc_id", F.explode(rows_of("response", "GROUPS:")).alias("row"))
    canon, rest = strip(F.substring_index("row", "|", 1)), F.when(F.instr("row", "|") > 0, F.regexp_extract("row", r"(?s)^[^|]*\|(.*)$", 1)).otherwise("")
    aliases = F.filter(F.transform(F.split(rest, ",", -1), strip), lambda a: a != "")
    return rows.select("doc_id", canon.alias("canonical"), F.explode(aliases).alias("alias")).where("canonical <> ''")


def decode_fixes(replies: DataFrame) -> DataFrame:
    """`index | speaker` -> doc_id, window_start, local_index, speaker; other rows are skipped."""
    rows = replies.select("doc_id", "window_start", F.explode(rows_of("response", "FIXES:")).alias("row")).where(F.instr("row", "|") > 0)
    index = strip(F.substring_index("row", "|", 1)).try_cast("int")
    return rows.select("doc_id", "window_start", index.alias("local_index"), strip(F.regexp_extract("row", r"(?s)^[^|]*\|(.*)$", 1)).alias("speaker")).where("local_index is not null and speaker <> ''")


def line_reference(c) -> tuple[Column, Column]:
    """First and last line number of a tolerant reference (`L1`, `1-3`, `<l2-L4>`); null where it is none."""
    x = F.upper(F.replace(F.btrim(strip(c), F.lit("<>[](){}")), F.lit(" "), F.lit("")))
    pattern = r"\AL?(\d+)(?:-L?(\d+))?\z"
    first = F.regexp_extract(x, pattern, 1).try_cast("int")
    return first, F.coalesce(F.regexp_extract(x, pattern, 2).try_cast("int"), first)


def _spans_of(lines: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, ls: a chunk's lines in order, as array<struct<line_no, start, end>>."""
    return lines.groupBy("doc_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("line_no", "start", "end"))).alias("ls"))


def _follows(rows: Column, row: Column, i: Column) -> Column:
    """The row's range begins where the one before it ended."""
    return F.coalesce(F.coalesce(F.get(rows, i - 1)["b"], F.lit(0)) + 1 == row["a"], F.lit(False))


def planned_parts(response, content, ls) -> Column:
    """array<struct<part_no, title, content, ok>> of a plan over a text and its lines (array<struct<start, end, …>>, in order),
    see decode_chunk_plan(); made in the row."""
    n = F.size(col(ls))

    def ranged(row):
        first, last = line_reference(F.substring_index(row, "|", 1))
        title = F.when(F.instr(row, "|") > 0, strip(F.regexp_extract(row, r"(?s)^[^|]*\|(.*)$", 1))).otherwise("")
        return F.struct(first.alias("a"), F.when((last < first) | (last > n), n).otherwise(last).alias("b"), title.alias("title"))

    def parts(rs, of):
        ok = F.forall(F.transform(rs, lambda r, i: _follows(rs, r, i)), lambda f: f) & F.coalesce(F.try_element_at(rs, F.lit(-1))["b"] == n, F.lit(False))
        name = lambda r, i: F.when(r["title"] == "", F.concat(F.lit("第"), i + 1, F.lit("块"))).otherwise(r["title"])
        text = lambda r: let(F.get(col(ls), r["a"] - 1)["start"], lambda begin: F.when(begin.isNotNull(), strip(cut(of, begin, F.get(col(ls), r["b"] - 1)["end"]))))
        return let(ok, lambda k: F.transform(rs, lambda r, i: F.struct((i + 1).alias("part_no"), name(r, i).alias("title"), text(r).alias("content"), k.alias("ok"))))

    return let(F.transform(rows_of(response, "CHUNKS:"), ranged), lambda rs: let(blocks(col(content)), lambda of: parts(rs, of)))


def decode_chunk_plan(plans: DataFrame, lines: DataFrame) -> DataFrame:
    """plans (doc_id, chunk_idx, content, response) and the chunk's lines -> doc_id, chunk_idx, part_no, title, content, ok.

    `range | title`; ok says that the ranges cover all lines once and in order. A range with an end before its start runs to
    the last line, as one without a known end does.
    """
    key = ["doc_id", "chunk_idx"]
    rows = plans.select(*key, "content", "response").join(_spans_of(lines), key)
    return rows.select(*key, F.explode(planned_parts("response", "content", "ls")).alias("x")).select(*key, "x.*")


def rewrite_rows(response) -> Column:
    """array<struct<a, b, new, known>>: `range =` keeps lines, `Lx ~ text` replaces one."""

    def ranged(row):
        swap = F.instr(row, " ~ ") > 0
        first, last = line_reference(F.when(swap, F.substring_index(row, " ~ ", 1)).otherwise(F.regexp_replace(row, r"=\s*$", "")))
        new = F.when(swap, strip(F.regexp_extract(row, r"(?s)^.*? ~ (.*)$", 1)))
        return F.struct(first.alias("a"), last.alias("b"), new.alias("new"), (swap | F.endswith(row, F.lit("="))).alias("known"))

    return F.transform(rows_of(response, "OPT:"), ranged)


def rewrites_cover(rows, ls) -> Column:
    """Whether rewrite_rows() cover all lines once and in order."""
    fine = lambda r, i: r["known"] & _follows(col(rows), r, i) & (r["b"] >= r["a"]) & (r["new"].isNull() | (r["a"] == r["b"]))
    every = F.forall(F.transform(col(rows), fine), lambda f: F.coalesce(f, F.lit(False)))
    return F.coalesce(every & (F.try_element_at(col(rows), F.lit(-1))["b"] == F.size(col(ls))), F.lit(False))


def decode_rewrites(plans: DataFrame, lines: DataFrame) -> DataFrame:
    """plans (doc_id, chunk_idx, content, response): `range =` keeps, `Lx ~ text` replaces one line -> doc_id, chunk_idx,
    content (rebuilt with what stood between the lines), ok (all lines covered once, in order). Of several rows over a line the
    first counts."""
    key = ["doc_id", "chunk_idx"]
    rows = plans.select(*key, "content", rewrite_rows("response").alias("rows")).join(_spans_of(lines), key)
    return rows.select(*key, strip(rewritten("content", "ls", "rows")).alias("content"), rewrites_cover("rows", "ls").alias("ok"))


#: A row of a compact reply: lines, role, emotion, confidence or anchor, anchor.
SEGMENT_ROW = r"^(L\d+)(?:-(L\d+))?\s+(\S+)\s+(\S+)(?:\s+(\S+)(?:\s+(.*))?)?$"


def _segment_rows(response: str) -> Column:
    body = F.when(F.instr(response, "SEGS:") > 0, F.substring(response, F.call_function("instr", F.col(response), F.lit("SEGS:")) + 5, F.length(response))).otherwise(F.col(response))
    return F.filter(rows_of(body, "SEGS:"), lambda r: ~F.startswith(r, F.lit("ROLES:")))


def readable_rows(response: str, lines: Column) -> Column:
    """The rows of a compact reply that decode_segments() can place among so many lines."""
    first = lambda r: F.substring(F.regexp_extract(r, SEGMENT_ROW, 1), 2, 9).try_cast("int")
    return F.filter(_segment_rows(response), lambda r: r.rlike(SEGMENT_ROW) & (first(r) >= 1) & (first(r) <= lines))


def _roles(response: str) -> Column:
    """array<struct<id, name, style>> of `ROLES: id=name|style, …`."""
    role_rows = F.filter(F.transform(F.split(response, "\n", -1), strip), lambda r: F.startswith(r, F.lit("ROLES:")))
    entry = lambda e: F.struct(strip(F.substring_index(e, "=", 1)).alias("id"), strip(F.substring_index(F.regexp_extract(e, r"(?s)^[^=]*=(.*)$", 1), "|", 1)).alias("name"), strip(F.replace(F.regexp_extract(e, r"(?s)^[^=|]*=[^|]*\|(.*)$", 1), F.lit("_"), F.lit(" "))).alias("style"))
    entries = F.filter(F.flatten(F.transform(role_rows, lambda r: F.filter(F.split(F.substring(r, F.lit(7), F.length(r)), ",", -1), lambda e: F.instr(e, "=") > 0))), lambda e: strip(F.substring_index(e, "=", 1)) != "")
    return F.transform(entries, entry)


def _segment(row: Column, roles: Column) -> Column:
    """struct<a, b, speaker, style, emotion, confidence_label, anchor> of a row of a compact reply."""
    g = lambda i: F.regexp_extract(row, SEGMENT_ROW, i)
    fourth = g(5)
    sure = fourth.isin(list(L.CONFIDENCE_CODES))
    role = F.try_element_at(F.filter(F.concat(F.array(F.struct(F.lit("0").alias("id"), F.lit("旁白").alias("name"), F.lit("female moderate pitch").alias("style"))), roles), lambda r: r["id"] == g(3)), F.lit(-1))
    speaker = F.when(g(3) == "?", "UNKNOWN").when(g(3) == "0", "旁白").otherwise(F.coalesce(F.nullif(role["name"], F.lit("")), F.lit("UNKNOWN")))
    return F.struct(
        F.substring(g(1), 2, 9).cast("int").alias("a"), F.substring(F.coalesce(F.nullif(g(2), F.lit("")), g(1)), 2, 9).cast("int").alias("b"),
        speaker.alias("speaker"), F.when(g(3) == "?", "").otherwise(F.coalesce(role["style"], F.lit(""))).alias("style"), _mapped(F.lower(g(4)), L.EMOTION_CODES, "neutral").alias("emotion"),
        F.when(sure, _mapped(fourth, L.CONFIDENCE_CODES, "high")).otherwise("high").alias("confidence_label"), strip(F.when(sure, g(6)).otherwise(F.concat_ws(" ", F.nullif(fourth, F.lit("")), F.nullif(g(6), F.lit(""))))).alias("anchor"),
    )


def segments_of(response: str, ls) -> Column:
    """array<struct<speaker, style, emotion, confidence_label, text, line_id>> of a compact reply over lines (array<struct<…,
    line_id, text>>, in order), see decode_segments(); made in the row."""
    n = F.size(col(ls))
    last = lambda r: F.when((r["b"] < r["a"]) | (r["b"] > n), n).otherwise(r["b"])
    placed = lambda r, i: F.transform(F.sequence(r["a"], last(r)), lambda no: F.struct(no.alias("line_no"), i.alias("row_no"), r.alias("row")))

    def step(s, t):
        anchor, line = t["row"]["anchor"], F.get(col(ls), t["line_no"] - 1)["text"]
        quoted = anchor.rlike('\\A"(?s:.+)"\\z') & (F.length(anchor) > 2)
        hit = lambda at: F.when(quoted, F.call_function("instr", F.substring(line, at + 1, F.length(line)), F.substring(anchor, F.lit(2), F.length(anchor) - 2))).otherwise(0)
        end = lambda at: let(hit(at), lambda h: F.when(h > 0, at + h - 1 + F.length(anchor) - 2).otherwise(F.greatest(F.length(line), at)))
        out = lambda at: let(end(at), lambda e: F.struct(t["line_no"].alias("line"), e.alias("at"), strip(F.substring(line, at + 1, e - at)).alias("text")))
        return let(F.when(s["line"] == t["line_no"], s["at"]).otherwise(0), out)

    def texts(takes):
        begin = F.struct(F.lit(0).alias("line"), F.lit(0).alias("at"), F.lit("").alias("text"))
        out = emitted(takes, "struct<line:int,at:int,text:string>", begin, step, lambda s: s["text"], "string")
        kept = F.filter(F.zip_with(takes, out, lambda t, x: F.struct(t["row_no"].alias("row_no"), t["line_no"].alias("line_no"), t["row"].alias("row"), x.alias("text"))), lambda t: t["text"] != "")
        told = lambda t: F.struct(*[t["row"][c].alias(c) for c in ("speaker", "style", "emotion", "confidence_label")], t["text"].alias("text"), F.get(col(ls), t["line_no"] - 1)["line_id"].alias("line_id"))
        return F.transform(F.sort_array(kept), told)

    rows = let(_roles(response), lambda roles: F.transform(F.filter(_segment_rows(response), lambda r: r.rlike(SEGMENT_ROW)), lambda r: _segment(r, roles)))
    takes = let(F.filter(rows, lambda r: r["a"].between(1, n)), lambda rs: F.sort_array(F.flatten(F.transform(rs, placed))))
    return let(takes, texts)


def decode_segments(replies: DataFrame, lines: DataFrame) -> DataFrame:
    """replies (doc_id, chunk_idx, response) and numbered lines -> doc_id, chunk_idx, seq, speaker, style, emotion,
    confidence_label, text, line_id.

    `ROLES: id=name|style, …` and rows `Lx[-Ly] role emotion [h|m|l] ["anchor"|rest]`. Anchors eat a line from left to right:
    an anchor takes what lies up to its end, anything else takes the rest. A reply meets its lines in one join.
    """
    key = ["doc_id", "chunk_idx"]
    per = lines.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("line_no", "line_id", "text"))).alias("ls"))
    both = replies.select(*key, "response").join(per, key)
    return both.select(*key, F.posexplode(segments_of("response", "ls")).alias("i", "s")).select(*key, (F.col("i") + 1).alias("seq"), "s.*")


def _balanced(text: str, start: int, brackets: str) -> int:
    """End of the bracket that opens at start, strings and escapes respected; -1 if it never closes."""
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c == brackets[0]:
            depth += 1
        elif c == brackets[1]:
            depth -= 1
            if not depth:
                return i + 1
    return -1


def recover(text: str | None) -> str | None:
    """The first JSON object in a noisy reply, else the first array, as text; null if neither parses."""
    if text is None:
        return None
    for brackets in ("{}", "[]"):
        at = text.find(brackets[0])
        while at >= 0:
            end = _balanced(text, at, brackets)
            if end > 0:
                try:
                    json.loads(text[at:end])
                    return text[at:end]
                except ValueError:
                    pass
            at = text.find(brackets[0], at + 1)
    return None


@F.pandas_udf(StringType())
def recover_json(texts: pd.Series) -> pd.Series:
    """recover() over a column; bracket matching is no regular language, so this is an Arrow batch function."""
    return texts.map(recover)


def recover_array(c) -> Column:
    """The JSON array of a reply that thinks aloud, as text: a fenced one if it parses, else the array that opens furthest to
    the right of all that close and parse; null if none does.

    A running sum over the brackets gives depths. Of the brackets that touch one depth, opening and closing ones alternate, so
    sorted by depth and place each bracket stands beside its partner. Candidates are parsed from the right until one fits.
    Brackets in strings count like others, as in an answer cut short nobody can tell.
    """
    kind = "struct<level:int,at:int,opens:boolean>"

    def paired(brackets):
        depths = running(F.transform(brackets, lambda b: F.when(b["raw"] == "[", 1).otherwise(-1)), lambda a, b: a + b)
        placed = F.zip_with(brackets, depths, lambda b, d: F.struct((d + (b["raw"] == "]").cast("int")).alias("level"), b["start"].alias("at"), (b["raw"] == "[").alias("opens")).cast(kind))
        beside = lambda xs: F.zip_with(xs, F.slice(xs, F.lit(2), F.size(xs)), lambda x, y: F.when(x["opens"] & ~y["opens"] & (x["level"] == y["level"]), F.struct(x["at"].alias("start"), (y["at"] + 1).alias("end"))))
        return let(F.array_sort(placed), lambda xs: F.sort_array(F.filter(beside(xs), lambda p: p.isNotNull()), asc=False))

    def parsed(piece):
        return F.when(_whole_json(piece), piece)

    def last(text):
        found = lambda parts, pairs: F.aggregate(pairs, F.lit(None).cast("string"), lambda acc, p: F.coalesce(acc, let(cut(parts, p["start"], p["end"]), parsed)))
        return let(blocks(text), lambda parts: let(let(spans(text, "[\\[\\]]"), paired), lambda pairs: found(parts, pairs)))

    fence = r"(?s)```(?:json)?\s*(\[.*?\])\s*```"
    return let(strip_thoughts(c), lambda text: F.coalesce(parsed(F.nullif(F.regexp_extract(text, fence, 1), F.lit(""))), last(text)))


def _whole_json(piece: Column) -> Column:
    """Whether a text is one JSON value: the parser ignores what follows one, but as a field and as an element nothing can."""
    tried = [F.try_parse_json(F.concat(F.lit(a), piece, F.lit(b))).isNotNull() for a, b in (('{"a":', "}"), ("[", "]"))]
    return tried[0] & tried[1]


def _first_bracketed(text: Column, opens: str, closes: str) -> Column:
    """From the first opening bracket to the one that closes it, brackets in strings not counted; null if none does."""
    token = f'(?s)"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+(?:"|\\z)|[\\{opens}\\{closes}]'

    def closed(rest):
        def upto(tokens):
            depths = running(F.transform(tokens, lambda t: F.when(t["raw"] == opens, 1).when(t["raw"] == closes, -1).otherwise(0)), lambda a, b: a + b)
            return let(F.array_position(depths, F.lit(0)), lambda i: F.when(i > 0, F.left(rest, F.get(tokens, i.cast("int") - 1)["end"])))

        return let(spans(rest, token), upto)

    at = F.instr(text, opens)
    return F.when(at > 0, let(F.substring(text, at, F.length(text)), closed))


def reply_object(c) -> Column:
    """The JSON object of a reply, as text: the whole reply if it is one, else what its first `{` opens, else what its first
    `[` opens; a list becomes {"segments": list}. Null where that is no JSON, or neither object nor list."""
    kind = lambda x: F.when(F.startswith(x, F.lit("{")), x).when(F.startswith(x, F.lit("[")), F.concat(F.lit('{"segments": '), x, F.lit("}")))
    snippet = lambda t: F.coalesce(_first_bracketed(t, "{", "}"), _first_bracketed(t, "[", "]"))
    found = lambda t: F.when(_whole_json(t), t).otherwise(let(snippet(t), lambda x: F.when(_whole_json(x), x)))
    return let(strip(c), lambda t: let(found(t), kind))


def decode_json_fixes(replies: DataFrame) -> DataFrame:
    """The long form of decode_fixes(): {"corrections": [{index, suggested_speaker, confidence}]}, of which only those of high
    confidence count; of several for a place the last one does."""
    item = "corrections array<struct<index:string,suggested_speaker:string,confidence:string>>"
    rows = replies.select("doc_id", "window_start", F.posexplode(F.from_json(reply_object("response"), item)["corrections"]).alias("pos", "x"))
    sure = rows.where(F.lower(strip(F.coalesce("x.confidence", F.lit("")))) == "high")
    placed = sure.select("doc_id", "window_start", "pos", F.col("x.index").try_cast("int").alias("local_index"), strip(F.coalesce("x.suggested_speaker", F.lit(""))).alias("speaker")).where("local_index is not null")
    return placed.groupBy("doc_id", "window_start", "local_index").agg(F.max_by("speaker", "pos").alias("speaker"))


def decode_json_guess(c) -> Column:
    """The long form of decode_pattern_guess(): {pattern, confidence, reason}; null without an object."""
    told = F.from_json(reply_object(c), "pattern string, confidence string, reason string")
    text = lambda k: strip(F.coalesce(told[k], F.lit("")))
    return let(told, lambda t: F.when(t.isNotNull(), F.struct(F.coalesce(F.nullif(text("pattern"), F.lit("")), F.lit("none")).alias("pattern"), text("confidence").alias("confidence"), text("reason").alias("reason"))))


def recover_choice(c) -> Column:
    """struct<choice, confidence> of a reply that is JSON, holds JSON, or only mentions both fields."""
    kind = "choice string, confidence double"
    whole = F.from_json(col(c), kind)
    inner = F.from_json(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), kind)
    choice = F.nullif(F.regexp_extract(col(c), r'choice"?\s*[:=]\s*"?([A-Za-z])', 1), F.lit(""))
    loose = F.struct(choice.alias("choice"), F.regexp_extract(col(c), r'confidence"?\s*[:=]\s*"?([0-9.]+)', 1).try_cast("double").alias("confidence"))
    return F.when(whole["choice"].isNotNull(), whole).when(inner["choice"].isNotNull(), inner).when(choice.isNotNull(), loose)


# ---- prompts ----


def batch_prompt(quotes: DataFrame, context: int = 200) -> DataFrame:
    """quotes with batch_no, batch_pos, candidates, hints, hint (place in the dialogue), warning and, if there is one, `previous`
    (see quotes.previous_speakers) -> doc_id, chapter_idx, batch_no, quote_ids, prompt: one text a batch, quotes in order."""
    spoke = [F.lit(" | "), F.col("previous")] if "previous" in quotes.columns else []
    names = F.filter("candidates", lambda n: ~n.isin(L.FALLBACK_CANDIDATES))
    shown = F.when(F.size(names) > 0, F.array_join(names, "、")).otherwise(F.array_join("hints", "、"))
    before, after = F.right("context_before", F.lit(context)), F.left("context_after", F.lit(context))
    item = F.concat(F.lit("--- "), F.col("batch_pos") + 1, F.lit(" | "), "quote_id", F.lit(" | "), shown, *spoke, F.when(F.col("hint") != "", F.concat(F.lit(" | "), F.col("hint"))).otherwise(""), F.lit(" ---\n前: "), before, F.lit("\n近: "), F.right(before, F.lit(40)), F.lit("\n句: "), "text", F.lit("\n后: "), after, F.when(F.col("warning") != "", F.concat(F.lit("\n"), F.col("warning"))).otherwise(""))
    rows = quotes.withColumn("item", item).groupBy("doc_id", "chapter_idx", "batch_no").agg(F.array_sort(F.collect_list(F.struct("batch_pos", "quote_id", "item"))).alias("items"))
    return rows.select("doc_id", "chapter_idx", "batch_no", F.transform("items", lambda i: i["quote_id"]).alias("quote_ids"), F.array_join(F.transform("items", lambda i: i["item"]), "\n").alias("prompt"))


def choice_task(quotes: DataFrame, context: int = 220) -> DataFrame:
    """quotes with candidates -> options (letter, name; at most 26, 未知 always among them) and contexts cut for one choice."""
    names = F.slice(F.array_distinct(F.concat("candidates", strings([L.UNKNOWN]))), 1, 26)
    options = F.transform(names, lambda n, i: F.concat(F.chr(i + 65), F.lit(". "), n))
    rest = F.substring("context_after", F.lit(2), F.length("context_after"))
    second = F.call_function("instr", rest, F.lit("「"))
    after = F.when(second > 0, F.left("context_after", second)).otherwise(F.col("context_after"))
    return quotes.withColumns({"options": options, "task_before": F.right("context_before", F.lit(context)), "task_after": F.left(after, F.lit(context))})


def single_choice(tasks: DataFrame) -> DataFrame:
    """choice_task() rows with a recorded `response` -> speaker, confidence, attribution_type: the option of the chosen letter;
    未知 at .2 where the reply names none."""
    told = tasks.withColumn("_c", recover_choice("response"))
    at = F.ascii(F.upper("_c.choice")) - 65
    name = F.transform("options", lambda o: F.substring(o, F.lit(4), F.length(o)))
    chosen = F.when(at >= 0, F.get(name, at))
    return told.withColumns({"speaker": F.coalesce(chosen, F.lit(L.UNKNOWN)), "confidence": F.when(chosen.isNull(), 0.2).otherwise(F.coalesce("_c.confidence", F.lit(0.5))), "attribution_type": F.when(chosen.isNull(), "unknown").otherwise("implicit")}).drop("_c")


def training_row(tasks: DataFrame, gold: str = "gold_speaker") -> DataFrame:
    """choice_task() rows with the letter of the gold name; null where it is no option."""
    at = F.array_position(F.transform("options", lambda o: F.substring(o, F.lit(4), F.length(o))), F.col(gold))
    return tasks.withColumn("gold_label", F.when(at > 0, F.chr(at + 64)))


def decode_pattern_guess(c) -> Column:
    """struct<pattern, confidence, reason> of a `PATTERN: pattern | confidence | reason` row; null without one."""
    row = F.try_element_at(F.filter(rows_of(c, "#"), lambda r: F.startswith(r, F.lit("PATTERN:"))), F.lit(1))
    parts = F.transform(F.split(F.substring(row, F.lit(9), F.length(row)), "\\|", 3), strip)
    get = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return F.when(row.isNotNull(), F.struct(F.coalesce(F.nullif(get(1), F.lit("")), F.lit("none")).alias("pattern"), get(2).alias("confidence"), get(3).alias("reason")))


#: Heads of the context block, for the compact and the long prompt.
CONTEXT_HEADS = {False: ("CTX", "角色: ", "摘要: ", "活跃: "), True: ("【跨块分析上下文】", "已知角色：", "上一块剧情摘要：", "上一块仍在对话的角色：")}


def context_prompt(chunks: DataFrame, verbose: bool = False) -> DataFrame:
    """chunks with title, numbered_text (or content, for the verbose form) and (nullable) known, summary, active -> prompt with a
    context block if any of them is set."""
    top, *heads = CONTEXT_HEADS[verbose]
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    inner = F.concat_ws("\n", *[part(label, c) for label, c in zip(heads, ("known", "summary", "active"))])
    body = F.concat(F.lit("请分析下面这段文本，并输出 JSON。\n\n标题："), "title", F.lit("\n\n正文：\n"), "content") if verbose else F.concat(F.lit("标题: "), "title", F.lit("\n"), "numbered_text")
    return chunks.withColumn("prompt", F.concat_ws("\n\n", F.when(inner != "", F.concat(F.lit(top + "\n"), inner)), body))
