"""Segments: sanitising, stable styles, suspicion marks, review items, registries, verification windows, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import lexicon as L
from ..functions.text import confidence_label, fallback_style, normalize_style, strip, style_with_gender
from .codecs import recover_choice


def sanitize(segments: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Trimmed speakers and texts (blank rows go), known emotions, whitelisted or fallback styles, then postprocess()."""
    speaker = F.coalesce(F.nullif(strip(F.coalesce("speaker", F.lit("旁白"))), F.lit("")), F.lit("旁白"))
    emotion = F.lower(strip(F.coalesce("emotion", F.lit("neutral"))))
    clean = segments.withColumns({"speaker": speaker, "text": strip(F.coalesce("text", F.lit(""))), "emotion": F.when(emotion.isin(L.EMOTIONS), emotion).otherwise("neutral")}).where("text <> ''")
    styled = clean.withColumn("style", F.coalesce(normalize_style("style"), fallback_style("speaker", "emotion")))
    return postprocess(styled, known)


def mark_suspicious(segments: DataFrame, known: list[str] | None = None) -> DataFrame:
    """needs_review for UNKNOWN, suspicious for speakers the book doesn't know; every other mark is cleared."""
    speaker = F.coalesce(F.nullif(strip("speaker"), F.lit("")), F.lit("旁白"))
    odd = F.lit(False) if not known else (F.col("speaker") != "UNKNOWN") & (F.col("speaker") != "旁白") & ~F.col("speaker").isin(known)
    return segments.withColumn("speaker", speaker).withColumns({"needs_review": F.col("speaker") == "UNKNOWN", "suspicious": odd})


def dominant_styles(segments: DataFrame) -> DataFrame:
    """doc_id, speaker, style: the most frequent style of a speaker, the first seen among equals."""
    styled = segments.select("doc_id", "seq", "speaker", style_with_gender("style", "speaker", "emotion").alias("style"))
    counted = styled.groupBy("doc_id", "speaker", "style").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return counted.groupBy("doc_id", "speaker").agg(F.max_by("style", F.struct("n", -F.col("first"))).alias("style"))


def stabilize_styles(segments: DataFrame) -> DataFrame:
    main = dominant_styles(segments).withColumnRenamed("style", "_main")
    return segments.join(main, ["doc_id", "speaker"], "left").withColumn("style", style_with_gender(F.coalesce("_main", "style"), "speaker", "emotion")).drop("_main").select(*segments.columns)


def postprocess(segments: DataFrame, known: list[str] | None = None) -> DataFrame:
    return stabilize_styles(mark_suspicious(segments, known))


def mark_missing_from_source(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """Marks speakers that never occur in the document's text; documents without text mark nothing."""
    # a document's names travel to its text, not its text to each name
    names = segments.where(~F.col("speaker").isin("", "旁白", "我", "UNKNOWN")).groupBy("doc_id").agg(F.collect_set("speaker").alias("_names"))
    told = docs.where(F.col("text") != "").select("doc_id", "text").join(names, "doc_id")
    absent = told.select("doc_id", F.explode(F.filter("_names", lambda n: ~F.contains(F.col("text"), n))).alias("speaker")).distinct().withColumn("review_reason", F.lit("speaker_missing_from_source"))
    marked = segments.join(absent, ["doc_id", "speaker"], "left")
    missing = F.col("review_reason").isNotNull()
    had = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in segments.columns else F.lit(False)
    return marked.withColumns({"needs_review": missing | had("needs_review"), "suspicious": missing | had("suspicious")})


def review_items(segments: DataFrame, threshold: float = L.REVIEW_THRESHOLD) -> DataFrame:
    wanted = ["doc_id", "seq", "quote_id", "text", "speaker", "confidence", "candidates", "candidate_sources", "scene_characters", "evidence"]
    return segments.where(F.col("confidence") < threshold).select(*[c for c in wanted if c in segments.columns])


def review_stats(segments: DataFrame, threshold: float = L.REVIEW_THRESHOLD) -> DataFrame:
    return segments.groupBy("doc_id").agg(F.count("*").alias("quote_count"), F.count_if(F.col("confidence") < threshold).alias("review_count"), F.count_if(F.col("speaker").isin("未知", "UNKNOWN")).alias("unknown_count"), F.count_if((F.col("confidence") < 0.5) | F.col("speaker").isin("未知", "UNKNOWN")).alias("needs_review_count"))


def parse_stats(segments: DataFrame, threshold: float = L.REVIEW_THRESHOLD) -> DataFrame:
    """Per document: quotes, those to review, and how many the rules (`ruled`) and a service resolved."""
    solved = ~F.col("speaker").isin("未知", "UNKNOWN")
    return segments.groupBy("doc_id").agg(
        F.count("*").alias("quote_count"), F.count_if(F.col("confidence") < threshold).alias("review_count"),
        F.count_if("ruled").alias("pre_resolved"), F.count_if(~F.col("ruled") & solved).alias("llm_resolved"),
    )


def to_export(segments: DataFrame) -> DataFrame:
    """Segments with a confidence label and a review mark, as they leave the engine."""
    return segments.withColumns({"confidence_label": confidence_label("confidence"), "needs_review": F.col("speaker").isin("未知", "UNKNOWN") | (F.col("confidence") < 0.5)})


def review_recorded(segments: DataFrame, replies: DataFrame, threshold: float = L.REVIEW_THRESHOLD) -> DataFrame:
    """Segments with recorded replies (doc_id, seq, response; null for a failed call) to the choices below the threshold.

    The reply's letter names an option: the segment's candidates in order, then 未知. Another name replaces the speaker, the
    same one or 未知 confirms it; `review` says what was done. A join, no fold, as recorded replies need no order.
    """
    chosen = recover_choice("response")
    given = replies.select("doc_id", "seq", chosen["choice"].alias("_letter"), F.coalesce(chosen["confidence"], F.lit(0.5)).alias("_sure"))
    options = F.slice(F.array_distinct(F.concat("candidates", F.array(F.lit(L.UNKNOWN)))), 1, 26)
    both = segments.join(given, ["doc_id", "seq"], "left").withColumn("_new", F.get(options, F.ascii(F.upper("_letter")) - 65))
    low = F.col("confidence") < threshold
    other = F.col("_new").isNotNull() & (F.col("_new") != F.col("speaker")) & (F.col("_new") != L.UNKNOWN)
    review = F.when(~low, "skipped").when(F.col("_letter").isNull(), "failed").when(other, "corrected").otherwise("confirmed")
    told = both.withColumn("review", review)
    is_ = lambda x: F.col("review") == x
    choice = F.concat(F.lit("LLM复核: 选择 "), F.upper("_letter"))
    agreed = F.concat(F.coalesce("evidence", F.lit("")), F.lit("；LLM确认("), F.format_string("%.2f", "_sure"), F.lit(")"))
    new = {
        "speaker": F.when(is_("corrected"), F.col("_new")).otherwise(F.col("speaker")),
        "attribution_type": F.when(is_("corrected"), "implicit").otherwise(F.col("attribution_type")),
        "evidence": F.when(is_("corrected"), choice).when(is_("confirmed"), agreed).otherwise(F.col("evidence")),
        "confidence": F.when(is_("corrected"), F.col("_sure")).when(is_("confirmed"), F.least(F.col("confidence") + 0.12, F.lit(0.85))).otherwise(F.col("confidence")),
    }
    return told.withColumns(new).select(*segments.columns, "review")


def review_counts(reviewed: DataFrame) -> DataFrame:
    """Per document: reviewed segments, and how each review ended."""
    ended = lambda x: F.count_if(F.startswith("review", F.lit(x)))
    return reviewed.groupBy("doc_id").agg((F.count("*") - ended("skipped")).alias("total_reviewed"), *[ended(x).alias(x) for x in ("corrected", "confirmed", "failed", "skipped")])


def review_pair(segments: DataFrame, replies: DataFrame, seq: int, threshold: float = L.REVIEW_THRESHOLD) -> DataFrame:
    """doc_id, before, after, review: one segment of each document before and after its review."""
    one = segments.where(F.col("seq") == seq)
    after = review_recorded(one, replies, threshold)
    pair = lambda x: F.struct("speaker", "confidence", "evidence").alias(x)
    return one.select("doc_id", pair("before")).join(after.select("doc_id", pair("after"), "review"), "doc_id")


def review_write_back(segments: DataFrame, ranker, threshold: float = L.REVIEW_THRESHOLD, window: int = 4) -> DataFrame:
    """Ask `ranker` about segments below the threshold, in order; its answers feed the next questions' recent speakers."""
    def fold(pdf):
        pdf, confirmed = pdf.sort_values("seq").copy(), []
        rows = pdf.to_dict("records")
        for row in rows:
            if row["confidence"] < threshold:
                try:
                    speaker, confidence, evidence, _ = ranker.rank(row, list(row["candidates"]), confirmed[-window:])
                except Exception as failure:  # a failed call leaves the row as it was
                    row["review"] = f"failed: {failure}"
                    continue
                if speaker and speaker not in (row["speaker"], "未知"):
                    row.update(speaker=speaker, confidence=confidence, attribution_type="implicit", evidence=f"LLM复核: {evidence or ''}", review="corrected")
                else:
                    row.update(confidence=min(row["confidence"] + 0.12, 0.85), evidence=f"{row['evidence'] or ''}；LLM确认({confidence:.2f})", review="confirmed")
            if row["speaker"] not in L.FALLBACK_CANDIDATES:
                confirmed.append(row["speaker"])
        return type(pdf)(rows, columns=list(pdf.columns))

    marked = segments.withColumn("review", F.when(F.col("confidence") >= threshold, "skipped"))
    return marked.groupBy("doc_id").applyInPandas(fold, marked.schema)


def review_one(segments: DataFrame, ranker, seq: int, threshold: float = L.REVIEW_THRESHOLD) -> DataFrame:
    """Review a single segment of each document: all others are lifted to the threshold first."""
    lifted = segments.withColumn("confidence", F.when((F.col("seq") != seq) & (F.col("confidence") < threshold), threshold).otherwise(F.col("confidence")))
    return review_write_back(lifted, ranker, threshold).where(F.col("seq") == seq)


def observed_names(segments: DataFrame) -> DataFrame:
    real = segments.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(L.REGISTRY_SKIP))
    return real.groupBy("doc_id").agg(F.array_sort(F.collect_set("speaker")).alias("names"))


def known_characters(segments: DataFrame) -> DataFrame:
    """doc_id, names in order of first appearance."""
    first = segments.where(~F.col("speaker").isin(L.REGISTRY_SKIP)).groupBy("doc_id", "speaker").agg(F.min("seq").alias("first"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "speaker"))), lambda x: x["speaker"]).alias("names"))


def active_speakers(segments: DataFrame, last: int = 10, most: int = 3) -> DataFrame:
    """doc_id, names: up to `most` speakers of the last rows, the latest first."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("seq").desc()))
    tail = segments.select("doc_id", "speaker", place.alias("place")).where(F.col("place") <= last).where(~F.col("speaker").isin(L.REGISTRY_SKIP))
    return tail.groupBy("doc_id").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "speaker"))), lambda x: x["speaker"])), 1, most).alias("names"))


def verify_windows(segments: DataFrame, size: int = 20, step: int = 15) -> DataFrame:
    """doc_id, window_start, local_index, seq, speaker, text: overlapping windows from 0 until the end (seq from 1)."""
    at = F.col("seq") - 1
    first = F.greatest(F.lit(0), F.ceil((at - size + 1) / step).cast("int"))
    starts = F.transform(F.sequence(first, F.floor(at / step).cast("int")), lambda k: k * step)
    return segments.select("doc_id", "seq", "speaker", "text", F.explode(starts).alias("window_start")).select("doc_id", "window_start", (F.col("seq") - 1 - F.col("window_start")).cast("int").alias("local_index"), "seq", "speaker", "text")


def apply_fixes(segments: DataFrame, fixes: DataFrame) -> DataFrame:
    """fixes (doc_id, window_start, local_index, speaker): the latest window wins; empty and UNKNOWN are ignored."""
    real = fixes.where("speaker <> '' and speaker <> 'UNKNOWN' and local_index >= 0")
    best = real.groupBy("doc_id", (F.col("window_start") + F.col("local_index") + 1).alias("seq")).agg(F.max_by("speaker", "window_start").alias("_fix"))
    return segments.join(best, ["doc_id", "seq"], "left").withColumn("speaker", F.coalesce("_fix", "speaker")).drop("_fix")


def consecutive_groups(chunks: DataFrame, key) -> DataFrame:
    """chunks (doc_id, chunk_idx, …) with group_no: a key that comes back later is a new group."""
    w = Window.partitionBy("doc_id").orderBy("chunk_idx")
    marked = chunks.withColumn("_key", key)
    new = F.when(F.lag("_key").over(w) == F.col("_key"), 0).otherwise(1)
    return marked.withColumn("_new", new).withColumn("group_no", F.sum("_new").over(w).cast("int")).drop("_key", "_new")


def evaluate(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Accuracy, unknown rate and candidate recall by attribution type, with a total (null type)."""
    p = predicted.select("doc_id", "quote_id", F.col("speaker").alias("_said"), "candidates")
    both = gold.join(p, ["doc_id", "quote_id"], "left")
    return both.rollup("attribution_type").agg(
        F.count("*").alias("n"), F.avg((F.coalesce("_said", F.lit("")) == F.col("speaker")).cast("double")).alias("accuracy"),
        F.avg(F.coalesce("_said", F.lit("未知")).isin("未知", "UNKNOWN").cast("double")).alias("unknown_rate"),
        F.avg(F.coalesce(F.array_contains("candidates", F.col("speaker")), F.lit(False)).cast("double")).alias("candidate_recall"),
    )


def compare_gold(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """A full outer join by quote: missed and spurious quotes stay, as rows with one side null."""
    g = gold.select("doc_id", "quote_id", F.col("speaker").alias("gold_speaker"), F.col("attribution_type").alias("gold_type"), F.size("scene_characters").alias("scene_size"))
    p = predicted.select("doc_id", "quote_id", F.col("speaker").alias("said"), "candidates")
    return g.join(p, ["doc_id", "quote_id"], "full")


def evaluation_report(compared: DataFrame) -> DataFrame:
    """One row over compare_gold(): precision, recall and F1 of quotes, coverage, and accuracies overall, of explicit, implicit
    and crowded quotes, with the unknown rate and the candidates' recall. A rate over nothing is null."""
    gold, said = F.col("gold_speaker").isNotNull(), F.col("said").isNotNull()
    right = F.coalesce(F.col("said") == F.col("gold_speaker"), F.lit(False)).cast("double")
    rate = lambda value, over: F.avg(F.when(over, value))
    one = compared.agg(
        F.count_if(gold).alias("gold_quotes"), F.count_if(said).alias("found_quotes"), F.count_if(gold & said).alias("matched"),
        rate(right, gold).alias("accuracy"), rate(right, gold & F.startswith("gold_type", F.lit("explicit"))).alias("explicit_accuracy"),
        rate(right, gold & (F.col("gold_type") == "implicit")).alias("implicit_accuracy"), rate(right, gold & (F.col("scene_size") > 2)).alias("crowded_accuracy"),
        rate(F.coalesce("said", F.lit("未知")).isin("未知", "UNKNOWN").cast("double"), gold).alias("unknown_rate"),
        rate(F.coalesce(F.array_contains("candidates", F.col("gold_speaker")), F.lit(False)).cast("double"), gold).alias("candidate_recall"),
    )
    share = lambda x, n: F.when(n > 0, x / n)
    precision, recall = share(F.col("matched"), F.col("found_quotes")), share(F.col("matched"), F.col("gold_quotes"))
    return one.withColumns({"quote_precision": precision, "quote_recall": recall, "quote_f1": F.when(F.col("found_quotes") + F.col("gold_quotes") > 0, 2 * F.col("matched") / (F.col("found_quotes") + F.col("gold_quotes")))})


def diagnostics(events: DataFrame, segments: DataFrame | None = None, most: int = 80) -> DataFrame:
    """events (run, seq, type, …) -> run, counts by type and the first `most` events of each run; with the run's segments
    (run, speaker, needs_review) also how many need review and how many have no speaker."""
    counts = events.groupBy("run", "type").agg(F.count("*").alias("n")).groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts"))
    head = events.withColumn("_p", F.row_number().over(Window.partitionBy("run").orderBy("seq"))).where(F.col("_p") <= most).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", "type"))).alias("events"))
    told = counts.join(head, "run")
    if segments is None:
        return told
    per = segments.groupBy("run").agg(F.count_if("needs_review").alias("needs_review_count"), F.count_if(F.upper(strip("speaker")) == "UNKNOWN").alias("unknown_count"))
    return told.join(per, "run", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("needs_review_count", "unknown_count")})


def progress_events(batches: DataFrame) -> DataFrame:
    """batches (doc_id, n quotes, at their place) -> doc_id, step, event, done, total: a progress event a batch and one for
    completion. While a job runs, observed() gives the same counts live."""
    w = Window.partitionBy("doc_id")
    running = batches.select("doc_id", F.row_number().over(w.orderBy("at")).alias("step"), F.sum("n").over(w.orderBy("at")).alias("done"), F.sum("n").over(w).alias("total"))
    steps = running.select("doc_id", "step", F.lit("progress").alias("event"), "done", "total")
    ends = running.groupBy("doc_id").agg((F.max("step") + 1).alias("step"), F.max("total").alias("total")).select("doc_id", "step", F.lit("complete").alias("event"), F.col("total").alias("done"), "total")
    return steps.unionByName(ends)


def observed(segments: DataFrame, name: str = "progress"):
    """(segments, Observation): rows, doubtful rows and documents counted while another action reads the segments."""
    from pyspark.sql import Observation

    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("confidence") < L.REVIEW_THRESHOLD).alias("doubtful"), F.count_if(F.col("speaker").isin("未知", "UNKNOWN")).alias("unknown")]
    return segments.observe(seen, *counts), seen
