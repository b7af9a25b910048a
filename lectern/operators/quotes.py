"""Quotes of a document with offsets and contexts, dialogue blocks, narration between quotes, chapters of quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as L
from ..functions.spans import blocks, cut, running, spans
from ..functions.text import clean_narration, let, lstrip, strip


#: Name and verb of a colon quote are one run of at most 26 word characters before the colon. Looking for that first gives the same
#: matches; without it each character is tried with every length of a name and every verb.
_COLON_QUOTE = "(?=[一-龥A-Za-z0-9_]{2,26}+[：:])" + L.COLON_QUOTE


def normalised(docs: DataFrame) -> DataFrame:
    from ..functions.text import normalize_text

    return docs.withColumn("text", normalize_text("text"))


def _marks(text) -> Column:
    """Quotes of a text in order: bracket quotes that are no mere nouns, and colon quotes that don't begin inside a kept
    bracket quote. Ends so far are a running maximum over both kinds, so no quote is compared with all others."""
    after = lambda parts, s: lstrip(cut(parts, s["end"], s["end"] + 4))
    mark = lambda s, start, inner, colon: F.struct(s["start"].alias("raw_start"), F.lit(colon).alias("colon"), s["end"].alias("raw_end"), start.alias("start"), strip(inner).alias("text"), s["raw"].alias("raw"))
    said = lambda raw: F.regexp_extract(raw, "[：:](.*)", 1)

    def both(parts):
        brackets = F.filter(spans(text, L.BRACKET_QUOTE), lambda s: ~after(parts, s).rlike(L.NOMINAL_AFTER))
        first = F.transform(brackets, lambda s: mark(s, s["start"], F.substring(s["raw"], F.lit(2), F.length(s["raw"]) - 2), False))
        second = F.transform(spans(text, _COLON_QUOTE), lambda s: mark(s, s["end"] - F.length(said(s["raw"])), said(s["raw"]), True))
        return F.sort_array(F.concat(first, second))

    def free(marks):
        reach = running(F.transform(marks, lambda m: F.when(m["colon"], 0).otherwise(m["raw_end"])), F.greatest)
        return let(reach, lambda r: F.filter(marks, lambda m, i: ~m["colon"] | (F.get(r, i) <= m["raw_start"])))

    return let(blocks(text), lambda parts: let(both(parts), free))


def extract_quotes(docs: DataFrame, context: int = L.CONTEXT_CHARS) -> DataFrame:
    """docs (doc_id, text, normalised) -> doc_id, quote_no, quote_id, text, start, end, raw_start, raw_end, contexts, raw.

    One pass, no shuffle: spans, containment, numbering and contexts are made inside the row, in time that follows the length
    of the text; only finished quotes are exploded, never the text with them.
    """

    def cited(text):
        near = lambda parts, m: F.struct(m.alias("m"), strip(cut(parts, F.greatest(F.lit(0), m["start"] - context), m["start"])).alias("before"), strip(cut(parts, m["raw_end"], m["raw_end"] + context)).alias("after"))
        return let(blocks(text), lambda parts: F.transform(_marks(text), lambda m: near(parts, m)))

    rows = docs.select("doc_id", F.posexplode(let("text", cited)).alias("pos", "q"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("quote_no"), F.format_string("q%04d", F.col("pos") + 1).alias("quote_id"), "q.m.text", "q.m.start", F.col("q.m.raw_end").alias("end"), "q.m.raw_start", "q.m.raw_end", F.col("q.before").alias("context_before"), F.col("q.after").alias("context_after"), "q.m.raw")


def _by_doc(*more):
    return Window.partitionBy("doc_id", *more).orderBy("quote_no")


def dialogue_blocks(quotes: DataFrame, gap: int = L.DIALOGUE_GAP) -> DataFrame:
    """Quotes at most `gap` characters apart form a block; `hint` names the place in it unless it stands alone."""
    apart = F.coalesce(F.col("raw_start") - F.lag("raw_end").over(_by_doc()) > gap, F.lit(True))
    numbered = quotes.withColumn("block", F.sum(apart.cast("int")).over(_by_doc()).cast("int"))
    size = F.count("*").over(Window.partitionBy("doc_id", "block"))
    place = F.row_number().over(_by_doc("block"))
    hint = F.when(size == 1, "").otherwise(F.concat(F.lit("对话块#"), F.col("block"), F.lit(" 第"), place, F.lit("/"), size, F.lit("句")))
    return numbered.select(*quotes.columns, "block", place.alias("block_pos"), size.cast("int").alias("block_size"), hint.alias("hint"))


def narration_gaps(docs: DataFrame, quotes: DataFrame, context: int = L.CONTEXT_CHARS) -> DataFrame:
    """Cleaned text between quotes: doc_id, before_quote (the quote number it precedes; one more than the last for the
    tail), quote_id, text, contexts.

    Offsets of a document's quotes travel to its text as one array, so the text is shuffled once and cut inside its row.
    """
    per = quotes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("quote_no", "quote_id", "raw_start", "raw_end"))).alias("qs"))
    kind = "array<struct<before_quote:int,quote_id:string,upto:int>>"

    def gaps(text, qs):
        ends = F.concat(F.array(F.lit(0)), running(F.transform(qs, lambda q: q["raw_end"]), F.greatest))
        heads = F.transform(qs, lambda q: F.struct(q["quote_no"], F.concat(q["quote_id"], F.lit("_n1")), q["raw_start"]))
        tail = F.array(F.struct(F.coalesce(F.try_element_at(qs, F.lit(-1))["quote_no"], F.lit(0)) + 1, F.lit("tail_n1"), F.length(text)))
        open_ = F.zip_with(F.concat(heads.cast(kind), tail.cast(kind)), ends, lambda g, e: F.struct(g.alias("g"), e.alias("begin")))
        wide = F.filter(open_, lambda o: o["begin"] < o["g"]["upto"])
        return let(blocks(text), lambda parts: F.transform(wide, lambda o: F.struct(o["g"]["before_quote"].alias("before_quote"), o["g"]["quote_id"].alias("quote_id"), cut(parts, o["begin"], o["g"]["upto"]).alias("raw"))))

    none = F.array().cast("array<struct<quote_no:int,quote_id:string,raw_start:int,raw_end:int>>")
    found = docs.select("doc_id", "text").join(per, "doc_id", "left").select("doc_id", F.explode(let("text", lambda t: let(F.coalesce("qs", none), lambda qs: gaps(t, qs)))).alias("g"))
    text = found.select("doc_id", "g.before_quote", "g.quote_id", clean_narration("g.raw").alias("text"))
    return text.where("text <> ''").select("*", F.left("text", F.lit(context)).alias("context_before"), F.right("text", F.lit(context)).alias("context_after"))


def chapter_of_quotes(docs: DataFrame, quotes: DataFrame, *carried: str) -> DataFrame:
    """doc_id, quote_id, the carried columns, chapter_idx: how many headings begin at or before the quote (0 before the first).

    Headings and quotes of a document are one ordered stream, in which headings are counted: an as-of join by union and sort.
    """
    heads = docs.select("doc_id", F.explode(F.transform(spans("text", L.CHAPTER_OFFSET), lambda s: s["start"])).alias("at"))
    said = quotes.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("kind"), "quote_id", *carried)
    both = said.unionByName(heads.select("doc_id", "at", F.lit(0).alias("kind")), allowMissingColumns=True)
    # equal keys are peers of one range, so a heading at a quote's very place counts for it
    upto = Window.partitionBy("doc_id").orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("chapter_idx", F.count_if(F.col("kind") == 0).over(upto).cast("int"))
    return counted.where("kind = 1").select("doc_id", "quote_id", *carried, "chapter_idx")


def chapter_openings(docs: DataFrame, window: int = 400) -> DataFrame:
    """doc_id, chapter_idx, heading, opening (up to `window` characters after the heading's line, none of the next chapter);
    chapter 0 is what stands before the first heading.

    A heading's match ends with its line, so its own text says where lines end; openings are cut out of blocks of the text, and
    only finished ones are exploded.
    """

    def openings(text, heads):
        size = F.length(text)

        def one(parts, h, i):
            raw, at = h["raw"], h["start"]
            skip = F.startswith(raw, F.lit("\n")).cast("int")
            closed = h["end"] < size
            breaks = lambda begin: F.call_function("locate", F.lit("\n"), raw, begin + 1)
            # where the line ends that begins at `begin` of the match, seen from the match; null if the text ends first
            stop = lambda begin: F.when(breaks(begin) > 0, breaks(begin) - 1).when(closed, F.length(raw))
            heading = F.when(stop(skip).isNotNull(), F.substring(raw, skip + 1, stop(skip) - skip)).otherwise(cut(parts, at + skip, at + skip + 80))
            start = at + F.coalesce(stop(F.lit(0)), F.lit(0))
            upto = F.coalesce(F.get(heads, i + 1)["start"], size)
            return F.struct(strip(heading).alias("heading"), cut(parts, start, F.least(start + window, upto)).alias("opening"))

        front = F.struct(F.lit("").alias("heading"), F.substring(text, F.lit(1), F.least(F.lit(window), F.coalesce(F.get(heads, F.lit(0))["start"], size))).alias("opening"))
        return let(blocks(text), lambda parts: F.concat(F.array(front), F.transform(heads, lambda h, i: one(parts, h, i))))

    made = let("text", lambda text: let(spans(text, L.CHAPTER_OFFSET), lambda heads: openings(text, heads)))
    return docs.where("text is not null").select("doc_id", F.posexplode(made).alias("chapter_idx", "o")).select("doc_id", "chapter_idx", "o.*")


def previous_speakers(answered: DataFrame, shown: int = L.RECENT) -> DataFrame:
    """Quotes in batches (doc_id, chapter_idx, batch_no, batch_pos, quote_no) with the `speaker` of a reply (null: none) -> the
    same rows with `previous`, the name that a batch's prompt shows beside each quote.

    A batch is told the last `shown` named speakers of the batches before it in its chapter: its first quote the last of them,
    quote i the one at place i - 1. Their names are looked up backwards, past unnamed quotes, so a row carries `shown` names.
    """
    named = F.when(~F.coalesce("speaker", F.lit(L.UNKNOWN)).isin(L.FALLBACK_CANDIDATES), F.col("speaker"))
    back = [F.expr(f"lag(_named, {k}) ignore nulls over (partition by doc_id, chapter_idx order by quote_no)") for k in range(shown, 0, -1)]
    at_first = Window.partitionBy("doc_id", "chapter_idx", "batch_no").orderBy("quote_no")
    rows = answered.withColumn("_named", named).withColumn("_back", F.array_compact(F.array(*back))).withColumn("_back", F.first("_back").over(at_first))
    opening = F.coalesce(F.try_element_at("_back", F.lit(-1)), F.lit("（批次首条）"))
    previous = F.when(F.col("batch_pos") == 0, opening).otherwise(F.coalesce(F.get("_back", F.col("batch_pos") - 1), F.lit(L.UNKNOWN)))
    return rows.withColumn("previous", previous).drop("_named", "_back")


def quote_batches(quotes: DataFrame, size: int = 10) -> DataFrame:
    """Batches of `size` quotes in document order within a chapter (column chapter_idx)."""
    place = F.row_number().over(_by_doc("chapter_idx")) - 1
    return quotes.withColumns({"batch_no": F.floor(place / size).cast("int"), "batch_pos": F.pmod(place, F.lit(size)).cast("int")})
