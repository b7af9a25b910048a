"""More registered queries: stages over recorded replies, reviews, evaluation, exports, sources and speech planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..functions.lines import line_array
from ..operators import attribution, audio, candidates, codecs, quotes, resplit, segments, service, splitting
from ..sources import io
from . import adapters as A, oracles as O
from .novel import merge_aliases, optimise_chunks, parse_novel_batch, plan_and_optimise, plan_chunks, presplit, verify_speakers
from .registry import query

_S = A.STRIP
_KNOWN = "('未知', 'UNKNOWN')"


def _pick(values, index):
    return F.element_at(T.strings(values), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


# ---- preprocessing and structure ----


@query(O.preprocess_info())
def preprocess_info(spark, sf_dir):
    base, text, info = T.preprocess_steps(A.prose(spark, sf_dir), "text")
    rows = base.select("doc_id", text.alias("text"), info.alias("i")).select("doc_id", "text", "i.*")
    return rows.withColumn("rule_hits", F.array_join(F.transform("rule_hits", lambda h: F.concat(h["id"], F.lit("="), h["count"])), ","))


@query(O.structure_info())
def structure_info(spark, sf_dir):
    wanted = ["doc_id", "method", "heading_pattern", "chapter_count", "seed_chunk_count", "used_llm_detection", "llm_pattern", "target_chars", "max_chars", "original_chars", "processed_chars", "applied"]
    return splitting.structure_info(A.books(spark, sf_dir), 600, 1200, guess="md_heading", guess_reason="?").select(*wanted)


@query(O.line_slices())
def line_slices(spark, sf_dir):
    chunks = A.books(spark, sf_dir).select("doc_id", F.lit(0).alias("chunk_idx"), F.lit("t").alias("title"), F.col("text").alias("content"))
    return splitting.line_slices(chunks, 900, 12)


@query(O.coerced_chunks())
def coerced_chunks(spark, sf_dir):
    c = A._table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    item = F.struct(F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" 题"), "turn")).alias("title"), F.when(F.col("turn") % 4 == 1, "  ").otherwise(F.col("text")).alias("content"))
    replies = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", item.alias("x")))), lambda r: r["x"])).alias("response"))
    return splitting.coerce_chunks(replies.withColumn("title", F.lit("章")))


@query(
    "select c_custkey, case when d and (e = 'gguf' or ends_with(m, '.gguf')) then 4200 when d then 5200 else 6000 end as target, case when d and (e = 'gguf' or ends_with(m, '.gguf')) then 5600 when d then 7600 else 12000 end as most "
    "from (select c_custkey, c_custkey % 2 = 0 as d, case when c_custkey % 3 = 0 then 'gguf' else '' end as e, case when c_custkey % 5 = 0 then lower(c_name) || '.gguf' else lower(c_name) end as m from customer)"
)
def segmentation_params(spark, sf_dir):
    k = F.col("c_custkey")
    target, most = splitting.segmentation_params(F.when(k % 2 == 0, " Direct"), F.when(k % 3 == 0, "GGUF"), F.when(k % 5 == 0, F.concat("c_name", F.lit(".gguf"))).otherwise(F.col("c_name")))
    return A._table(spark, sf_dir, "customer").select("c_custkey", target.alias("target"), most.alias("most"))


@query(O.context_groups())
def context_groups(spark, sf_dir):
    return service.context_groups(splitting.detect_structure(A.books(spark, sf_dir), 600, 1200).withColumn("title", F.concat("title", F.lit(" - x")))).select("doc_id", "chunk_idx", "group_no")


@query(O.heading_split())
def heading_split(spark, sf_dir):
    return splitting.split_by_headings(A.books(spark, sf_dir), "chapter_en")


@query(O.perspective_stats())
def perspective_stats(spark, sf_dir):
    opened = quotes.chapter_openings(quotes.normalised(A.prose(spark, sf_dir)))
    return attribution.perspective_stats(opened.withColumn("shifted", attribution.perspective_shift("heading", "opening", F.lit(A.NAMES[0]), T.strings(A.NAMES))))


# ---- stages over recorded replies ----


def _fix_replies(rows: DataFrame) -> DataFrame:
    """Replies to verification windows: every third segment is renamed, by its window."""
    shown = segments.verify_windows(rows)
    row = F.when(F.col("seq") % 3 == 0, F.concat(F.col("local_index"), F.lit(" | 改"), F.col("seq"), F.lit("w"), F.col("window_start"))).otherwise(F.concat(F.col("local_index"), F.lit(" | UNKNOWN")))
    return shown.groupBy("doc_id", "window_start").agg(F.concat(F.lit("FIXES:\n"), F.array_join(F.collect_list(row), "\n")).alias("response"))


@query(f"with {A.SQL_SEGMENTS} select doc_id, seq, case when seq % 3 = 0 then '改' || seq || 'w' || (((seq - 1) // 15) * 15) else speaker end as speaker from seg")
def verification(spark, sf_dir):
    rows = A.segments(spark, sf_dir)
    return verify_speakers(rows, _fix_replies(rows)).select("doc_id", "seq", "speaker")


@query(f"with {A.SQL_SEGMENTS} select doc_id, seq, case when seq % 6 = 0 then '改' || seq || 'w' || (((seq - 1) // 15) * 15) else speaker end as speaker from seg")
def verification_verbose(spark, sf_dir):
    """JSON replies to verification windows, in prose: of two fixes to every third segment the sure one of every sixth counts."""
    rows = A.segments(spark, sf_dir)
    shown = segments.verify_windows(rows).where("seq % 3 = 0")
    sure = F.when(F.col("seq") % 2 == 0, " High ").otherwise("medium")
    item = F.concat(F.lit('{"index": '), "local_index", F.lit(', "suggested_speaker": "改'), F.col("seq").cast("string"), F.lit("w"), F.col("window_start").cast("string"), F.lit('", "confidence": "'), sure, F.lit('"}, {"index": '), "local_index", F.lit(', "suggested_speaker": "x{", "confidence": "low"}'))
    replies = shown.groupBy("doc_id", "window_start").agg(F.concat(F.lit('Checked "all" of it:\n{"corrections": ['), F.array_join(F.collect_list(item), ", "), F.lit("]}\nDone }")).alias("response"))
    return verify_speakers(rows, replies, verbose=True).select("doc_id", "seq", "speaker")


_PROPS = "case event_id % 5 when 0 then props when 1 then props when 2 then '{\"segments\": [' || props || ', 3]}' when 4 then '{\"segments\": [[' || event_id || ']]}' end"


@query(f"select event_id, {_PROPS} as json from events where props is not null")
def reply_objects(spark, sf_dir):
    """The object of each reply: whole, in prose, a list, cut short, a list in prose."""
    e = A._table(spark, sf_dir, "events").where("props is not null")
    shapes = [F.col("props"), F.concat(F.lit('so "ok" '), "props", F.lit(' and "}" then }')), F.concat(F.lit("["), "props", F.lit(", 3]")), F.concat(F.lit("cut "), F.left("props", F.length("props") - 1)), F.concat(F.lit("see [["), F.col("event_id").cast("string"), F.lit("]] "))]
    reply = F.element_at(F.array(*shapes), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", codecs.reply_object(reply).alias("json"))


@query(f"with {A.SQL_SEGMENTS} select doc_id, seq, case when seq % 3 = 1 then speaker when seq % 3 = 2 then 'none' end as pattern, case when seq % 3 = 1 then 'high' when seq % 3 = 2 then '' end as confidence, case when seq % 3 = 1 then '{{a}}' when seq % 3 = 2 then '' end as reason from seg")
def pattern_guess_json(spark, sf_dir):
    """Guesses at the heading pattern in JSON: no object, one in prose, an empty one."""
    reply = F.when(F.col("seq") % 3 == 0, "no answer").when(F.col("seq") % 3 == 1, F.concat(F.lit('I say {"pattern": " '), "speaker", F.lit(' ", "confidence": "high", "reason": "{a}"} ok'))).otherwise("{}")
    return A.segments(spark, sf_dir).select("doc_id", "seq", codecs.decode_json_guess(reply).alias("g")).select("doc_id", "seq", "g.pattern", "g.confidence", "g.reason")


_NAMED = "speaker not in ('旁白', 'UNKNOWN', '未知')"


@query(f"""
with {A.SQL_PROSE}, {A.SQL_SEGMENTS},
nm as (select doc_id, string_agg(distinct speaker, ', ' order by speaker) as known, arg_max(speaker, seq) as active from seg where {_NAMED} group by doc_id),
c as (select doc_id, text, nullif(known, '') as known, case when doc_id % 2 = 0 then active end as active from docs left join nm using (doc_id))
select doc_id,
  case when known is null and active is null then '' else 'CTX' || chr(10) || concat_ws(chr(10), '角色: ' || known, '活跃: ' || active) || chr(10) || chr(10) end || '标题: t' || chr(10) || text as compact,
  case when known is null and active is null then '' else '【跨块分析上下文】' || chr(10) || concat_ws(chr(10), '已知角色：' || known, '上一块仍在对话的角色：' || active) || chr(10) || chr(10) end
    || '请分析下面这段文本，并输出 JSON。' || chr(10) || chr(10) || '标题：t' || chr(10) || chr(10) || '正文：' || chr(10) || text as verbose
from c""")
def context_prompts(spark, sf_dir):
    """Both forms of the prompt of a chunk, with what is known of the chunks before."""
    named = A.segments(spark, sf_dir).where(_NAMED)
    known = named.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ", ").alias("known"), F.max_by("speaker", "seq").alias("last"))
    chunks = A.prose(spark, sf_dir).join(known, "doc_id", "left").select("doc_id", F.lit("t").alias("title"), F.col("text").alias("numbered_text"), F.col("text").alias("content"), "known", F.lit(None).cast("string").alias("summary"), F.when(F.col("doc_id") % 2 == 0, F.col("last")).alias("active"))
    both = codecs.context_prompt(codecs.context_prompt(chunks).withColumnRenamed("prompt", "compact"), verbose=True)
    return both.select("doc_id", "compact", F.col("prompt").alias("verbose"))


@query(f"with {A.SQL_SEGMENTS} select doc_id, seq, speaker from seg")
def verification_without_fixes(spark, sf_dir):
    rows = A.segments(spark, sf_dir)
    replies = segments.verify_windows(rows).select("doc_id", "window_start").distinct().withColumn("response", F.lit("FIXES:\n99 | x"))
    return verify_speakers(rows, replies).select("doc_id", "seq", "speaker")


@query(f"with {A.SQL_SEGMENTS}, n as (select doc_id, count(distinct speaker) filter (speaker not in ('旁白', 'UNKNOWN', '')) as k from seg group by doc_id) select doc_id, seq, case when speaker = '苏晚' and k > 1 then '苏菲亚' else speaker end as speaker from seg join n using (doc_id)")
def alias_merge(spark, sf_dir):
    rows = A.segments(spark, sf_dir)
    replies = rows.select("doc_id").distinct().withColumn("response", F.lit("GROUPS:\n苏菲亚 | 苏晚, 无人"))
    return merge_aliases(rows, replies).select("doc_id", "seq", "speaker")


def _prose_chunks(spark, sf_dir):
    return A.prose(spark, sf_dir).select("doc_id", F.lit(0).alias("chunk_idx"), F.lit("t").alias("title"), F.col("text").alias("content"))


def _line_counts(chunks):
    """doc_id, chunk_idx, n of the chunks that have a line."""
    return chunks.select("doc_id", "chunk_idx", F.size(line_array("content")).alias("n")).where("n > 0")


def _plan_replies(chunks):
    """Half of the plans cut a chunk after its second line, the other half leave a gap and are no plans."""
    cut = F.when(F.col("doc_id") % 2 == 0, "CHUNKS:\nL1-L2 | 头\nL3- | 尾").otherwise("CHUNKS:\nL2 | x")
    return _line_counts(chunks).select("doc_id", "chunk_idx", F.replace(cut, F.lit("L3-"), F.concat(F.lit("L3-L"), "n")).alias("response"))


@query(O.chunk_planning())
def chunk_planning(spark, sf_dir):
    chunks = _prose_chunks(spark, sf_dir)
    return plan_chunks(chunks, _plan_replies(chunks))


@query(O.chunk_rewriting())
def chunk_rewriting(spark, sf_dir):
    chunks = _prose_chunks(spark, sf_dir)
    n = _line_counts(chunks)
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("OPT:\nL1 ~ 新\nL2-L"), "n", F.lit(" ="))).otherwise("OPT:\nL1 =")
    return optimise_chunks(chunks, n.select("doc_id", "chunk_idx", reply.alias("response")))


@query(O.plan_then_rewrite())
def plan_then_rewrite(spark, sf_dir):
    chunks = _prose_chunks(spark, sf_dir)
    nothing = chunks.select("doc_id", "chunk_idx", F.lit("OPT:\nL99 =").alias("response"))
    return plan_and_optimise(chunks, _plan_replies(chunks), nothing)


@query(O.presplit_chunks())
def presplit_chunks(spark, sf_dir):
    books = A.books(spark, sf_dir).select("doc_id", F.lit(0).alias("chunk_idx"), F.lit("t").alias("title"), F.col("text").alias("content"))
    return presplit(books, 1500, 20)


def _batches(spark, sf_dir):
    text = quotes.normalised(A.prose(spark, sf_dir))
    found = quotes.extract_quotes(text)
    return quotes.quote_batches(quotes.chapter_of_quotes(text, found, "quote_no")).select("doc_id", "chapter_idx", "batch_no").distinct()


def _batch_replies(batches):
    answers = "\n".join(f"{i}|{A.NAMES[i % 4]}|0.{i % 10}|{'im' if i % 2 else 'zz'}|e{i}" for i in range(1, 10)) + "\n1|苏晚|0.95|ea|again\nbad | row"
    return batches.select("doc_id", "chapter_idx", "batch_no", F.lit(answers).alias("response"))


@query()
def batch_attribution(spark, sf_dir):
    """Rules first, recorded replies for the rest, then the corrections."""
    open_ = parse_novel_batch(A.prose(spark, sf_dir), A.NAMES, _every_batch(spark, sf_dir), A.NAMES[0], infer=False)
    return open_.select("doc_id", "seq", "speaker", "confidence", "attribution_type", "ruled")


def _every_batch(spark, sf_dir):
    """The same reply to whatever batches are left open: batches never outnumber a chapter's quotes."""
    text = quotes.normalised(A.prose(spark, sf_dir))
    found = quotes.extract_quotes(text)
    return _batch_replies(quotes.quote_batches(quotes.chapter_of_quotes(text, found, "quote_no")).select("doc_id", "chapter_idx", "batch_no").distinct())


@query()
def batch_stats(spark, sf_dir):
    return segments.parse_stats(parse_novel_batch(A.prose(spark, sf_dir), A.NAMES, _every_batch(spark, sf_dir), A.NAMES[0], infer=False))


def _recorded_calls(spark, sf_dir, most_chars: int = 2000):
    """The prose's numbered lines, and a recorded call for every range of them of up to so many characters, or of one line."""
    chunks = _prose_chunks(spark, sf_dir)
    lines = splitting.number_lines(chunks.select("doc_id", "chunk_idx", "content")).withColumn("title", F.lit("t"))
    size = F.greatest(F.lit(1), F.length("text"))
    chunk = Window.partitionBy("doc_id", "chunk_idx")
    sized = lines.select("doc_id", "chunk_idx", "line_no", size.alias("len"), (F.sum(size).over(chunk.orderBy("line_no")) - size).alias("begin"))
    # a line meets the lines that begin within reach of it, not all of its chunk
    near = F.collect_list(F.struct("line_no", (F.col("begin") + F.col("len")).alias("end"))).over(chunk.orderBy("begin").rangeBetween(0, most_chars - 1))
    ahead = sized.select("doc_id", "chunk_idx", F.col("line_no").alias("first"), "begin", near.alias("near"))
    ranges = ahead.select("doc_id", "chunk_idx", "first", "begin", F.explode("near").alias("b")).where((F.col("b.line_no") == F.col("first")) | (F.col("b.end") - F.col("begin") <= most_chars))
    calls = ranges.select("doc_id", "chunk_idx", "first", F.col("b.line_no").alias("last")).withColumns({"error": F.expr(O.CALL_KIND), "unreadable": F.expr(O.CALL_UNREADABLE)})
    rest = F.when(F.col("last") > F.col("first"), F.concat(F.lit("\nL2-L"), F.col("last") - F.col("first") + 1, F.lit(" 1 ne h"))).otherwise("")
    reply = F.when(F.col("error").isNull(), F.when(F.col("unreadable"), "I cannot do that.").otherwise(F.concat(F.lit("ROLES: 1=陆沉|male_adult\nSEGS:\nL1 0 co m"), rest)))
    return lines, calls.select("doc_id", "chunk_idx", "first", "last", reply.alias("response"), "error")


@query(O.chunk_analysis())
def chunk_analysis(spark, sf_dir):
    """Numbered lines over recorded calls that fail in every way: cut smaller by kind, what can't be cut kept with its reason."""
    return resplit.analyse_recorded(*_recorded_calls(spark, sf_dir), 1000, 40)


@query(O.resplit_events())
def chunk_resplits(spark, sf_dir):
    """Every cut and every range given up on the way."""
    return resplit.resplit_events(*_recorded_calls(spark, sf_dir), 1000, 40)


# ---- reviews ----


def _reviewable(spark, sf_dir):
    """Segments with candidates, and recorded choices: A, B, C, no reply."""
    rows = A.segments(spark, sf_dir).withColumn("candidates", T.strings(["陆沉", "苏晚"]))
    reply = F.when(F.col("seq") % 4 == 3, F.lit(None)).otherwise(F.concat(F.lit('{"choice": "'), F.chr(F.lit(65) + F.col("seq") % 4), F.lit('", "confidence": 0.9}')))
    return rows, rows.select("doc_id", "seq", reply.alias("response"))


_REVIEW = """
rv0 as (select *, ['陆沉','苏晚','未知'][(seq % 4) + 1] as nw, seq % 4 = 3 as failed from seg),
rv as (
  select *, case when confidence >= 0.7 then 'skipped' when failed then 'failed' when nw <> speaker and nw <> '未知' then 'corrected' else 'confirmed' end as review from rv0
),
reviewed as (
  select doc_id, seq, review, case when review = 'corrected' then nw else speaker end as speaker,
    case when review = 'corrected' then 0.9::double when review = 'confirmed' then least(confidence + 0.12::double, 0.85::double) else confidence end as confidence,
    case when review = 'corrected' then 'implicit' else attribution_type end as attribution_type,
    case when review = 'corrected' then 'LLM复核: 选择 ' || chr((65 + seq % 4)::int) when review = 'confirmed' then evidence || '；LLM确认(0.90)' else evidence end as evidence
  from rv
)"""


@query(f"with {A.SQL_SEGMENTS}, {_REVIEW} select doc_id, seq, review, speaker, confidence, attribution_type, evidence from reviewed")
def review_recorded(spark, sf_dir):
    return segments.review_recorded(*_reviewable(spark, sf_dir)).select("doc_id", "seq", "review", "speaker", "confidence", "attribution_type", "evidence")


@query(f"with {A.SQL_SEGMENTS}, {_REVIEW} select doc_id, count(*) filter (review <> 'skipped') as total_reviewed, count(*) filter (review = 'corrected') as corrected, count(*) filter (review = 'confirmed') as confirmed, count(*) filter (review = 'failed') as failed, count(*) filter (review = 'skipped') as skipped from reviewed group by doc_id")
def review_counts(spark, sf_dir):
    return segments.review_counts(segments.review_recorded(*_reviewable(spark, sf_dir)))


@query(f"with {A.SQL_SEGMENTS}, {_REVIEW} select r.doc_id, s.speaker as before_speaker, s.confidence as before_confidence, r.speaker as after_speaker, r.confidence as after_confidence, review from reviewed r join seg s using (doc_id, seq) where seq = 2")
def review_one_pair(spark, sf_dir):
    both = segments.review_pair(*_reviewable(spark, sf_dir), 2)
    return both.select("doc_id", F.col("before.speaker").alias("before_speaker"), F.col("before.confidence").alias("before_confidence"), F.col("after.speaker").alias("after_speaker"), F.col("after.confidence").alias("after_confidence"), "review")


# ---- evaluation and diagnostics ----


def _gold_lines(spark, sf_dir):
    d = A._table(spark, sf_dir, "documents").join(A._table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    kind = F.when(F.col("quality") == 1, "explicit_before").otherwise("implicit")
    scene = F.slice(T.strings(["a", "b", "c", "d"]), F.lit(1), (F.col("doc_id") % 4 + 1).cast("int"))
    one = F.struct(F.concat(F.lit("q"), "doc_id").alias("quote_id"), F.col("lang").alias("speaker"), kind.alias("attribution_type"), scene.alias("scene_characters"))
    return d.select("doc_id", F.when(F.col("doc_id") % 17 == 0, "{broken").otherwise(F.to_json(one)).alias("json"))


_GOLD = (
    "lb as (select doc_id, max(quality) as quality from labels group by doc_id), gold as (select d.doc_id, 'q' || d.doc_id as quote_id, d.lang as speaker, case when quality = 1 then 'explicit_before' else 'implicit' end as attribution_type, (d.doc_id % 4 + 1)::int as scene_size "
    "from documents d join lb using (doc_id) where d.doc_id % 17 <> 0 and d.lang is not null), pred as (select doc_id, 'q' || doc_id as quote_id, case when doc_id % 5 = 0 then '未知' when doc_id % 3 = 0 then 'en' else lang end as said from documents where doc_id % 7 <> 0), "
    "cmp as (select g.doc_id as gd, p.doc_id as pd, g.speaker, g.attribution_type, g.scene_size, p.said from gold g full join pred p using (doc_id, quote_id))"
)


def _predicted(spark, sf_dir):
    said = F.when(F.col("doc_id") % 5 == 0, "未知").when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang"))
    return A._table(spark, sf_dir, "documents").where("doc_id % 7 <> 0").select("doc_id", F.concat(F.lit("q"), "doc_id").alias("quote_id"), said.alias("speaker"), T.strings(["en", "fr"]).alias("candidates"))


@query(f"with {_GOLD} select doc_id, quote_id, speaker, attribution_type, scene_size from gold")
def gold_import(spark, sf_dir):
    return io.gold_of(_gold_lines(spark, sf_dir)).select("doc_id", "quote_id", "speaker", "attribution_type", F.size("scene_characters").alias("scene_size"))


@query(
    f"with {_GOLD}, a as (select count(gd) as gold_quotes, count(pd) as found_quotes, count(*) filter (gd is not null and pd is not null) as matched, "
    "avg(coalesce(said = speaker, false)::int::double) filter (gd is not null) as accuracy, avg(coalesce(said = speaker, false)::int::double) filter (gd is not null and starts_with(attribution_type, 'explicit')) as explicit_accuracy, "
    "avg(coalesce(said = speaker, false)::int::double) filter (gd is not null and attribution_type = 'implicit') as implicit_accuracy, avg(coalesce(said = speaker, false)::int::double) filter (gd is not null and scene_size > 2) as crowded_accuracy, "
    "avg((coalesce(said, '未知') in ('未知', 'UNKNOWN'))::int::double) filter (gd is not null) as unknown_rate, avg((pd is not null and speaker in ('en', 'fr'))::int::double) filter (gd is not null) as candidate_recall from cmp) "
    "select *, matched / found_quotes as quote_precision, matched / gold_quotes as quote_recall, 2 * matched / (found_quotes + gold_quotes) as quote_f1 from a"
)
def gold_evaluation(spark, sf_dir):
    return segments.evaluation_report(segments.compare_gold(_predicted(spark, sf_dir), io.gold_of(_gold_lines(spark, sf_dir))))


@query(
    f"with {A.SQL_SEGMENTS}, c as (select user_id as run, event_type, count(*) as n from events group by all), cs as (select run, string_agg(event_type || '=' || n, ',' order by event_type) as counts from c group by run), "
    "h as (select user_id as run, event_id, event_type, row_number() over (partition by user_id order by event_id) as p from events), hs as (select run, count(*) filter (p <= 5) as kept, string_agg(event_type, ',' order by event_id) filter (p <= 5) as events from h group by run), "
    "s as (select doc_id as run, count(*) filter (confidence < 0.5 or speaker in ('未知', 'UNKNOWN')) as needs_review_count, count(*) filter (speaker = 'UNKNOWN') as unknown_count from seg group by doc_id) "
    "select run, counts, events, coalesce(needs_review_count, 0) as needs_review_count, coalesce(unknown_count, 0) as unknown_count from cs join hs using (run) left join s using (run)"
)
def run_diagnostics(spark, sf_dir):
    events = A._table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"))
    rows = segments.to_export(A.segments(spark, sf_dir)).withColumnRenamed("doc_id", "run")
    told = segments.diagnostics(events, rows, 5)
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return told.select("run", counts.alias("counts"), F.array_join(F.transform("events", lambda e: e["type"]), ",").alias("events"), "needs_review_count", "unknown_count")


@query(
    f"with {A.SQL_SEGMENTS}, b as (select doc_id, (seq - 1) // 10 as pl, count(*) as n from seg group by all), p as (select doc_id, row_number() over (partition by doc_id order by pl) as step, sum(n) over (partition by doc_id order by pl) as done, sum(n) over (partition by doc_id) as total from b) "
    "select doc_id, step::int as step, 'progress' as event, done::bigint as done, total::bigint as total from p union all select doc_id, (max(step) + 1)::int, 'complete', max(total)::bigint, max(total)::bigint from p group by doc_id"
)
def progress_events(spark, sf_dir):
    batches = A.segments(spark, sf_dir).groupBy("doc_id", F.floor((F.col("seq") - 1) / 10).alias("at")).agg(F.count("*").alias("n"))
    return segments.progress_events(batches)


@query("select event_id, case when regexp_matches(m, '超时|timeout|timed out') then 'timeout' when regexp_matches(m, 'content_filter|内容过滤') then 'filter' when contains(m, 'finish_reason=length') then 'length' when regexp_matches(m, 'connection|rate limit|429|500|502|503|504') then 'transient' else 'decode' end as kind, contains(m, 'out of memory') and contains(m, 'mps') as memory, regexp_matches(m, 'huggingface|readtimeout|timed out') as recogniser from (select event_id, lower(event_type || ['Read Timed Out','CONTENT_FILTER','finish_reason=length','HTTP 503','MPS backend out of memory','HuggingFace ReadTimeout x','other'][(event_id % 7)::int + 1]) as m from events)")
def failure_kinds(spark, sf_dir):
    m = F.concat("event_type", _pick(["Read Timed Out", "CONTENT_FILTER", "finish_reason=length", "HTTP 503", "MPS backend out of memory", "HuggingFace ReadTimeout x", "other"], F.col("event_id")))
    return A._table(spark, sf_dir, "events").select("event_id", service.failure_kinds(m).alias("kind"), service.out_of_memory(m).alias("memory"), service.recogniser_failed(m).alias("recogniser"))


# ---- exports and sources ----


@query(f"with {A.SQL_SEGMENTS} select doc_id, seq, speaker, text, coalesce(nullif(emotion, ''), 'neutral') as emotion, nullif(style, '') as style, confidence, nullif(evidence, '') as evidence, attribution_type, scene_characters, context_before, case when confidence >= 0.85 then 'high' when confidence >= 0.7 then 'medium' else 'low' end as label, evidence as shown, speaker in {_KNOWN} or confidence < 0.5 as needs_review from seg")
def export_round_trip(spark, sf_dir):
    lines = io.export_segments(A.segments(spark, sf_dir))
    marks = lines.select("doc_id", "seq", F.get_json_object("json", "$._confidence").alias("label"), F.get_json_object("json", "$._evidence").alias("shown"), F.get_json_object("json", "$._needs_review").cast("boolean").alias("needs_review"))
    back = io.restore_segments(lines).select("doc_id", "seq", "speaker", "text", "emotion", "style", "confidence", "evidence", "attribution_type", "scene_characters", "context_before")
    return back.join(marks, ["doc_id", "seq"])


@query(f"with {A.SQL_SEGMENTS} select doc_id, count(*) as n, min(speaker) as low, max(speaker) as high from seg group by doc_id")
def object_export(spark, sf_dir):
    back = io.import_segments(io.as_objects(A.segments(spark, sf_dir)))
    return back.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("speaker").alias("low"), F.max("speaker").alias("high"))


_VOICES = "voices as (select s_suppkey, case when s_suppkey % 3 = 0 then s_name || ' Desktop' else s_name end as name, ['zh-CN','en-US','fr-FR'][(s_suppkey % 3)::int + 1] as locale, ['Female','male','x'][(s_suppkey % 3)::int + 1] as gender from supplier)"


def _voices(spark, sf_dir):
    s = A._table(spark, sf_dir, "supplier")
    return s.select(F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(" Desktop"))).otherwise(F.col("s_name")).alias("name"), _pick(["zh-CN", "en-US", "fr-FR"], F.col("s_suppkey")).alias("locale"), _pick(["Female", "male", "x"], F.col("s_suppkey")).alias("gender"), F.col("s_suppkey").alias("pos"))


@query(f"with {_VOICES} select c_custkey, v.name is not null as found, v.name as system_voice_name, case when v.name is not null then concat_ws(', ', case when lower(gender) in ('female', 'male') then lower(gender) end, case locale when 'zh-CN' then 'chinese accent' when 'en-US' then 'english accent' end, 'moderate pitch') end as voice_style from customer c left join voices v on replace(lower(v.name), ' desktop', '') = 'supplier#' || lpad((c_custkey % 20)::varchar, 9, '0')")
def voice_join(spark, sf_dir):
    wanted = A._table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  SUPPLIER#"), F.lpad((F.col("c_custkey") % 20).cast("string"), 9, "0"), F.lit(" Desktop ")).alias("voice_name"))
    return io.voice_join(wanted, _voices(spark, sf_dir)).select("c_custkey", "found", "system_voice_name", "voice_style")


@query(f"with {_VOICES} select name, locale from (select *, row_number() over (partition by replace(lower(name), ' desktop', ''), lower(locale) order by s_suppkey) as p from voices where locale in ('zh-CN', 'en-US')) where p = 1")
def voice_catalogue(spark, sf_dir):
    return io.voice_catalogue(_voices(spark, sf_dir), ["zh-CN", "EN-us"]).select("name", "locale")


@query("select page_id, 'p_' || page_id || '_' || left(sha256(coalesce(html, '')), 10) || '.wav' as file, octet_length(encode(coalesce(html, ''))) as bytes from pages where page_id is not null")
def upload_names(spark, sf_dir):
    p = A._table(spark, sf_dir, "pages").where("page_id is not null")
    body = F.base64(F.coalesce("html", F.lit("")).cast("binary"))
    name, raw = io.decode_upload(F.concat(F.lit("p "), "page_id", F.lit(".WAV")), F.when(F.col("page_id") % 2 == 0, body).otherwise(F.concat(F.lit("data:audio/wav;base64,"), body)))
    return p.select("page_id", name.alias("file"), F.octet_length(raw).cast("long").alias("bytes"))


@query("select c_custkey, case c_custkey % 3 when 0 then 'http://h/v1/x/' || c_custkey when 1 then 'https://o/' || c_custkey else '' end as url from customer")
def absolute_urls(spark, sf_dir):
    k = F.col("c_custkey")
    u = F.when(k % 3 == 0, F.concat(F.lit("/x/"), k)).when(k % 3 == 1, F.concat(F.lit("https://o/"), k)).otherwise("")
    return A._table(spark, sf_dir, "customer").select("c_custkey", io.absolute_url(F.lit("http://h/v1/"), u).alias("url"))


_KEY = _S("string_split(text, ' - ')[1]")


@query(f"with {A.SQL_SEGMENTS} select doc_id, seq, {_KEY} as chapter_key, coalesce(list_filter(list_transform(regexp_split_to_array({_S('text')}, '[。！？!?\n]'), lambda x: {_S('x')}), lambda x: x <> '')[-1], '') as last_sentence from seg")
def text_keys(spark, sf_dir):
    return A.segments(spark, sf_dir).select("doc_id", "seq", T.chapter_key("text").alias("chapter_key"), T.last_sentence("text").alias("last_sentence"))


@query(f"with {A.SQL_SEGMENTS}, x as (select doc_id, seq, '「' || case when seq % 3 = 0 then '看见陆沉，' else '' end || speaker as t from seg), c as (select *, {O._cut_ends("trim(replace(t, '「', ''), ' ，,。:：')", L.CANDIDATE_SUFFIXES, 1)} as n from x) select doc_id, seq, regexp_extract(case when starts_with(n, '看见') then substr(n, 3) else n end, '^[^对向冲从]*') as name from c")
def candidate_names(spark, sf_dir):
    raw = F.concat(F.when(F.col("seq") % 3 == 0, "看见陆沉，").otherwise(""), "speaker")
    return A.segments(spark, sf_dir).select("doc_id", "seq", T.candidate_name(raw, F.create_map().cast("map<string,string>")).alias("name"))


# ---- speech planning ----

_RENDERED = "inv as (select doc_id, seq, case when seq % 4 = 0 then 100 else len(text) * 1600 end as frames from seg)"


@query(
    f"with {A.SQL_SEGMENTS}, {_RENDERED}, u as (select doc_id, seq, frames / 16000.0::double as d, len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*')) as w, len(regexp_extract_all(text, '[，。！？、；：,.!?;:]')) as p from seg join inv using (doc_id, seq)), "
    "e as (select *, greatest(0.45::double, w / 2.4::double + least(p * 0.12::double, w / 2.4::double * 0.25::double)) as est from u) "
    "select doc_id, seq, d as duration_seconds, w < 2 or (d >= round(greatest(0.45::double, est * 0.35::double), 3) and d <= round(greatest(4.0::double, est * 2.8::double + 2.0::double), 3)) as valid from e"
)
def duration_validation(spark, sf_dir):
    rows = A.segments(spark, sf_dir)
    inventory = rows.select("doc_id", "seq", F.when(F.col("seq") % 4 == 0, 100).otherwise(F.length("text") * 1600).alias("frames"), F.lit(16000).alias("sample_rate"))
    return audio.validate_durations(rows, inventory).select("doc_id", "seq", "duration_seconds", "valid")


_VW = '(partition by "out", volume order by idx'


@query(
    f"""with {A.SQL_CLIPS}, v as (select *, ((row_number() over (partition by "out" order by idx) - 1) // 3 + 1)::int as volume from clips),
t as (select *, coalesce(sum(duration) over {_VW} rows between unbounded preceding and 1 preceding), 0) + (row_number() over {_VW}) - 1) * 0.35::double as off, case when trim(text) = '' then '' when speaker = '旁白' then trim(text) else speaker || '：' || trim(text) end as lyric from v)
select "out", volume, idx, (off * 100)::bigint as centis from t where lyric <> ''"""
)
def volume_timelines(spark, sf_dir):
    clips = audio.require_one_format(A.clips(spark, sf_dir))
    return audio.volume_lrc(clips, audio.pack_volumes(clips, most_items=3)).select("out", "volume", "idx", F.round(F.col("offset_seconds") * 100).cast("long").alias("centis"))


@query(f"with {A.SQL_SEGMENTS} select doc_id, seq, case when e in ('microsoft', 'voxcpm', 'remote') then e when e = 'mimo' then case when seq % 2 = 0 then 'mimo:clone' when seq % 3 = 0 then 'mimo:voice' else 'mimo:design' end else 'local' end as route from (select *, ['mimo','microsoft','voxcpm','remote','','other'][(seq % 6) + 1] as e from seg)")
def backend_routes(spark, sf_dir):
    e = _pick(["MIMO", "microsoft", "VoxCPM", "remote", "", "other"], F.col("seq"))
    route = audio.backend_route(e, F.when(F.col("seq") % 2 == 0, "x.wav"), F.when(F.col("seq") % 3 == 0, "v").otherwise(""))
    return A.segments(spark, sf_dir).select("doc_id", "seq", route.alias("route"))


# ---- one choice a quote ----


@query(O.single_choice())
def single_choice(spark, sf_dir):
    """Lettered options, recorded choices decoded back to names."""
    found = candidates.generate_candidates(_hinted(quotes.extract_quotes(quotes.normalised(A.prose(spark, sf_dir)))))
    tasks = codecs.choice_task(found)
    letter = F.chr(F.lit(65) + F.col("quote_no") % 5)
    reply = F.when(F.col("quote_no") % 7 == 6, "no choice").otherwise(F.concat(F.lit('{"choice": "'), letter, F.lit('", "confidence": 0.8}')))
    return codecs.single_choice(tasks.withColumn("response", reply)).select("doc_id", "quote_id", "speaker", "confidence", "attribution_type")


def _hinted(df: DataFrame) -> DataFrame:
    aliases = F.create_map(*[F.lit(n) for name in A.NAMES for n in (name, name)], F.lit("长风"), F.lit("顾长风"))
    return df.withColumns({"aliases": aliases, "hints": T.strings(A.NAMES), "narrator": F.lit(A.NAMES[0])})
