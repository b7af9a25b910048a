"""Whole pipelines: novel text to attributed segments, and chunk analysis by a chat service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import lexicon as L
from ..functions.lines import line_array, rewritten
from ..functions.text import strings, strip, tts_cleanup
from ..operators import attribution, candidates, codecs, consistency, quotes, segments, service, splitting


def _with_aliases(found: DataFrame, hints: list[str], narrator: str | None, infer: bool) -> DataFrame:
    """Quotes with hints, narrator and the alias map of their document, inferred aliases included (two passes)."""
    own = F.create_map(*[F.lit(x) for n in hints for x in (n, n)]) if hints else F.create_map().cast("map<string,string>")
    base = found.withColumns({"aliases": own, "hints": strings(hints), "narrator": F.lit(narrator).cast("string")})
    if not infer:
        return base
    seen = candidates.generate_candidates(base.drop("narrator")).select("doc_id", "quote_no", "candidates")
    observed = seen.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("quote_no", "candidates"))), lambda x: x["candidates"])).alias("observed")).withColumn("aliases", own)
    return base.drop("aliases").join(candidates.infer_aliases(observed).select("doc_id", "aliases"), "doc_id")


def parse_novel(docs: DataFrame, hints: list[str] | None = None, narrator: str | None = None, ranker=None, infer: bool = True, narration: bool = False) -> DataFrame:
    """docs (doc_id, text) -> segments with speaker, confidence, evidence, type, candidates, scene, contexts, in order.

    One fold per document decides quotes one after another; everything before it is row-local, everything after it shares the
    windows' partitioning by doc_id.
    """
    hints = hints or []
    text = quotes.normalised(docs)
    found = quotes.extract_quotes(text)
    kept = ("quote_id", "text", "context_before", "context_after")
    rows = attribution.classic(_with_aliases(found, hints, narrator, infer), ranker, carry=kept)
    if ranker is not None:
        rows = rows.join(found.select("doc_id", "quote_no", *kept), ["doc_id", "quote_no"])
    rows = rows.withColumn("_sub", F.lit(1))
    if narration:
        gaps = quotes.narration_gaps(text, found)
        told = gaps.select("doc_id", F.col("before_quote").alias("quote_no"), "quote_id", "text", "context_before", "context_after", F.lit(L.NARRATOR).alias("speaker"), F.lit(1.0).alias("confidence"), F.lit("引号外叙述文本").alias("evidence"), F.lit("narrator").alias("attribution_type"), F.lit(None).cast("string").alias("addressee"), strings([L.NARRATOR]).alias("candidates"), strings([]).alias("scene_characters"), F.lit(0).alias("_sub"))
        rows = rows.unionByName(told)
    ordered = rows.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("quote_no", "_sub"))).drop("_sub")
    return consistency.fix_consistency(ordered, narrator)


def parse_novel_batch(docs: DataFrame, hints: list[str], client: service.Chat | DataFrame, narrator: str | None = None, infer: bool = True) -> DataFrame:
    """The rules that are sure decide first; what they leave goes to a service in batches of ten a chapter.

    The narrator rule rests in chapters that somebody else tells. Only unresolved quotes reach the service.
    """
    text = quotes.normalised(docs)
    found = quotes.extract_quotes(text)
    base = _with_aliases(found, hints, narrator, infer).join(quotes.chapter_of_quotes(text, found), ["doc_id", "quote_id"])
    told = quotes.chapter_openings(text).select("doc_id", "chapter_idx", attribution.perspective_shift("heading", "opening", F.lit(narrator), strings(hints)).alias("shifted"))
    ranked = candidates.generate_candidates(base.join(told, ["doc_id", "chapter_idx"]))
    sure = F.coalesce(attribution.self_identified("text", "hints"), F.when(~F.col("shifted"), attribution.narrator_anchored("text", "narrator")), attribution.explicit_conservative("context_before", "context_after", "hints"))
    ruled = ranked.withColumn("sure", sure)
    placed = quotes.dialogue_blocks(ruled)
    names = F.filter("candidates", lambda n: ~n.isin(L.FALLBACK_CANDIDATES))
    shown = F.array_join(F.when(F.size(names) > 0, names).otherwise(F.col("hints")), "、")
    body = F.concat(F.lit("前: "), F.right("context_before", F.lit(200)), F.lit("\n近: "), F.right("context_before", F.lit(40)), F.lit("\n句: "), "text", F.lit("\n后: "), F.left("context_after", F.lit(200)), F.lit("\n"), attribution.addressee_hint("context_before", "hints"))
    open_ = placed.where("sure is null").select("doc_id", "chapter_idx", "quote_no", "quote_id", F.concat(shown, F.when(F.col("hint") != "", F.concat(F.lit(" | "), F.col("hint"))).otherwise("")).alias("head"), body.alias("body"))
    asked = service.attribute_batches(open_, client).select("doc_id", "quote_no", F.struct("speaker", "confidence", "evidence", "attribution_type", F.lit(None).cast("string").alias("addressee")).cast(attribution.ATTRIBUTION).alias("answer"))
    none = attribution.attribution(F.lit(L.UNKNOWN), 0.20, "归因失败（规则+LLM均无结果）", "unknown")
    rows = ruled.join(asked, ["doc_id", "quote_no"], "left").withColumn("a", F.coalesce("sure", "answer", none))
    out = rows.select("doc_id", F.col("quote_no").alias("seq"), "quote_id", "text", "a.*", "candidates", "candidate_sources", "scene_characters", "context_before", "context_after", F.col("sure").isNotNull().alias("ruled"))
    return consistency.fix_consistency(out, narrator)


def verify_speakers(rows: DataFrame, client: service.Chat | DataFrame, verbose: bool = False) -> DataFrame:
    """Windows of twenty segments, five of them shared, are shown to a service; its fixes are applied, later windows win. A
    verbose service answers in JSON and says how sure it is; only fixes of high confidence are taken then.

    As everywhere here, a table of recorded replies may stand for the service: service.ask() says how.
    """
    shown = segments.verify_windows(rows)
    item = F.concat(F.col("local_index"), F.lit(" | "), "speaker", F.lit(" | "), "text")
    prompts = shown.groupBy("doc_id", "window_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("local_index", item.alias("item")))), lambda x: x["item"]), "\n").alias("prompt"))
    replies = service.ask(prompts, client, ["doc_id", "window_start"]).where("response is not null")
    return segments.postprocess(segments.apply_fixes(rows, codecs.decode_json_fixes(replies) if verbose else codecs.decode_fixes(replies)))


def merge_aliases(rows: DataFrame, client: service.Chat | DataFrame) -> DataFrame:
    """Observed names of a document go to a service, its groups rename the speakers; failures rename nothing."""
    names = segments.observed_names(rows).where(F.size("names") > 1).select("doc_id", F.array_join("names", "\n").alias("prompt"))
    replies = service.ask(names, client, ["doc_id"]).where("response is not null")
    return candidates.canonicalize(rows, candidates.observed_aliases(rows, codecs.decode_alias_groups(replies)))


_KEY = ["doc_id", "chunk_idx"]


def _answered(chunks: DataFrame, client: service.Chat | DataFrame) -> DataFrame:
    """chunks with their lines (ls) and the reply to them, null where there is none. A chunk meets its reply in one join and
    is worked off in its row; of several recorded replies all rows count, so none of them is a plan."""
    said = client if isinstance(client, DataFrame) else service.ask(_numbered(chunks), client, _KEY)
    one = said.where("response is not null").groupBy(*_KEY).agg(F.array_join(F.array_sort(F.collect_list("response")), "\n").alias("response"))
    spans = F.transform("ls", lambda l: F.struct(l["start"].alias("start"), (l["start"] + F.length(l["text"])).alias("end")))
    both = chunks.select(*_KEY, "title", "content").join(one, _KEY, "left")
    return both.withColumn("ls", line_array(F.when(F.col("response").isNotNull(), F.col("content")))).withColumn("ls", spans)


def plan_chunks(chunks: DataFrame, client: service.Chat | DataFrame) -> DataFrame:
    """Chunks cut as a service plans it, where its plan covers all lines in order; else as they are."""
    parts = codecs.planned_parts("response", "content", "ls")
    whole = F.array(F.struct(F.lit(1).alias("part_no"), F.col("title"), F.col("content"), F.lit(False).alias("ok")))
    planned = _answered(chunks, client).withColumn("ps", F.when(F.size("ls") > 0, parts))
    kept = F.when(F.coalesce(F.try_element_at("ps", F.lit(1))["ok"], F.lit(False)), F.col("ps")).otherwise(whole)
    return planned.select(*_KEY, F.explode(kept).alias("p")).select(*_KEY, "p.part_no", "p.title", "p.content")


def optimise_chunks(chunks: DataFrame, client: service.Chat | DataFrame) -> DataFrame:
    """Chunks reworded by a service where its reply covers all lines, else cleaned by rule."""
    rows = _answered(chunks, client).withColumn("rows", codecs.rewrite_rows("response"))
    ok = codecs.rewrites_cover("rows", "ls") & (F.size("ls") > 0)
    # only what a reply covers is sent to be reworded
    told = rows.withColumn("told", F.when(ok, F.col("content")))
    return told.select(*_KEY, "title", F.coalesce(strip(rewritten("told", "ls", "rows")), tts_cleanup("content")).alias("content"))


def _numbered(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, prompt: title and numbered lines of the chunks that have any."""
    none = F.lit(None).cast("string")
    lines = chunks.select(*_KEY, "title", line_array("content").alias("ls")).where(F.size("ls") > 0)
    shown = F.transform("ls", lambda l, i: F.concat(F.lit("L"), i + 1, F.lit(": "), l["text"]))
    told = lines.select(*_KEY, "title", F.array_join(shown, "\n").alias("numbered_text"), none.alias("known"), none.alias("summary"), none.alias("active"))
    return codecs.context_prompt(told).select(*_KEY, "prompt")


def presplit(chunks: DataFrame, most_chars: int = 6000, most_lines: int = 120) -> DataFrame:
    """Chunks whose numbered text is long are cut into line slices before a service plans them; the others stay."""
    return splitting.slice_long_chunks(chunks, most_chars, most_lines)


def prompt_budget(target: int | None, max_tokens: int) -> int:
    """Characters that a planning prompt may show: the wish, or 2.4 a token, between 1,800 and 6,000."""
    return int(min(max(target or 2.4 * max_tokens, 1800), 6000))


def plan_and_optimise(chunks: DataFrame, planner: service.Chat | DataFrame, writer: service.Chat | DataFrame) -> DataFrame:
    """plan_chunks(), then optimise_chunks() on its parts, numbered anew within a document."""
    parts = plan_chunks(chunks, planner)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_idx", "part_no")) - 1
    return optimise_chunks(parts.select("doc_id", place.alias("chunk_idx"), "title", "content"), writer)


def analyse(docs: DataFrame, client: service.Chat, target: int = L.CHUNK_TARGET, most: int = L.CHUNK_MOST, mode: str = "chapter") -> DataFrame:
    """docs -> chunks -> numbered lines -> segments by a chat service -> stable styles and marks.

    `mode` says which chunks share a context: see service.context_groups().
    """
    chunks = service.context_groups(splitting.detect_structure(docs, target, most), mode)
    lines = splitting.number_lines(chunks.select("doc_id", "chunk_idx", "content")).join(chunks.select("doc_id", "chunk_idx", "group_no"), ["doc_id", "chunk_idx"])
    said = service.analyse_chunks(lines, client, by=("doc_id", "group_no"))
    numbered = said.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_idx", "seq")))
    return segments.mark_missing_from_source(segments.postprocess(numbered), docs)
