"""Corrections of attributed segments as window functions over one partitioning by document.

Passes run in a fixed order, each on the confidence the one before left: scene, addressee, jump, repeat, alternation,
unknown. All windows are partitioned by doc_id, so they share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as L
from ..functions.text import strip

PASSES = ("scene", "addressee", "jump", "repeat", "alternation", "unknown")


def _order():
    return Window.partitionBy("doc_id").orderBy("seq")


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(L.LEAST_CONFIDENCE), F.least(F.lit(1.0), c))


def _known(speaker) -> Column:
    return ~F.col(speaker).isin(L.SKIP_SPEAKERS)


def _fixable() -> Column:
    return (F.col("confidence") < L.HIGH_CONFIDENCE) & _known("speaker")


def _apply(df: DataFrame, hit: Column, penalty: float, note: Column, **more: Column) -> DataFrame:
    """Where hit: less confidence, a note, and the columns in `more`; the hit is fixed before anything changes."""
    marked = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    noted = F.when(F.coalesce("evidence", F.lit("")) != "", F.concat("evidence", F.lit("；"), note)).otherwise(note)
    new = {"evidence": noted, "confidence": _clamp(F.col("confidence") - penalty)} | more
    return marked.withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in new.items()}).drop("_hit")


def scene(df: DataFrame, narrator: str | None = None) -> DataFrame:
    absent = (F.size("scene_characters") > 0) & ~F.array_contains("scene_characters", F.col("speaker"))
    hit = _fixable() & absent & (F.lit(True) if not narrator else F.col("speaker") != narrator)
    return _apply(df, hit, L.SCENE_PENALTY, F.concat(F.lit("场景约束："), "speaker", F.lit(" 不在 scene_characters")))


def addressee(df: DataFrame) -> DataFrame:
    tail = F.right(F.coalesce("context_before", F.lit("")), F.lit(100))
    name, cue = F.regexp_extract(tail, L.ADDRESSEE_AT_END, 1), F.regexp_extract(tail, L.ADDRESSEE_AT_END, 0)
    hit = _fixable() & (name != "") & (F.endswith("speaker", name) | F.startswith("speaker", name))
    return _apply(df, hit, L.ADDRESSEE_PENALTY, F.concat(F.lit("受话人陷阱：前文「"), F.left(strip(cue), F.lit(20)), F.lit("」中 "), name, F.lit(" 是受话对象")))


def jump(df: DataFrame) -> DataFrame:
    """Speakers of the three rows before and after; narration rows take their places in the frame."""
    names = F.when(_known("speaker"), F.col("speaker"))
    near = F.array_sort(F.array_union(F.collect_set(names).over(_order().rowsBetween(-3, -1)), F.collect_set(names).over(_order().rowsBetween(1, 3))))
    df = df.withColumn("_near", near)
    hit = _fixable() & (F.col("confidence") >= 0.5) & (F.size("_near") > 0) & ~F.array_contains("_near", F.col("speaker"))
    note = F.concat(F.lit("跳变："), "speaker", F.lit(" 与前后窗口说话人 ['"), F.array_join("_near", "', '"), F.lit("'] 无交集"))
    return _apply(df, hit, L.JUMP_PENALTY, note).drop("_near")


def repeat(df: DataFrame) -> DataFrame:
    real = F.filter(F.coalesce("scene_characters", F.array().cast("array<string>")), lambda s: ~s.isin(L.SKIP_SPEAKERS))
    other = F.try_element_at(F.filter(real, lambda s: s != F.col("speaker")), F.lit(1))
    df = df.withColumn("_prev", F.lag("speaker").over(_order()))
    hit = (F.col("confidence") < L.HIGH_CONFIDENCE) & _known("speaker") & (F.col("_prev") == F.col("speaker")) & F.col("attribution_type").isin("implicit", "unknown") & (F.size(real) == 2) & other.isNotNull()
    return _apply(df, hit, L.REPEAT_PENALTY, F.concat(F.lit("双人重复惩罚："), "speaker", F.lit(" 连续发言，可能应为 "), other, F.lit("，建议复核"))).drop("_prev")


def alternation(df: DataFrame) -> DataFrame:
    """Rows inside a long uncertain run of one speaker between runs of one other speaker go to that other speaker.

    Islands are physical runs of one speaker below high confidence; a run begins at the island's first row below the flip
    confidence. The neighbours are the nearest other speakers, found on runs over the rows with a real speaker.
    """
    low = F.col("confidence") < L.HIGH_CONFIDENCE
    df = df.withColumns({"_rn": F.row_number().over(_order()), "_low": low, "_ls": F.lag("speaker").over(_order()), "_ll": F.lag(low).over(_order())})
    df = df.withColumn("_isl", F.sum(F.when(F.col("_low") & F.col("_ll") & (F.col("speaker") == F.col("_ls")), 0).otherwise(1)).over(_order()))
    real = F.when(_known("speaker"), F.col("speaker"))
    before = F.last(real, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(real, ignorenulls=True).over(_order().rowsBetween(1, Window.unboundedFollowing))
    df = df.withColumns({"_real": real, "_pb": before, "_na": after})
    df = df.withColumn("_begin", F.col("_real").isNotNull() & (F.col("_pb").isNull() | (F.col("_pb") != F.col("_real"))))
    df = df.withColumn("_run", F.sum(F.col("_begin").cast("int")).over(_order()))
    run, island = Window.partitionBy("doc_id", "_run"), Window.partitionBy("doc_id", "_isl")
    df = df.withColumns({"_p": F.max(F.when(F.col("_begin"), F.col("_pb"))).over(run), "_n": F.max(F.when(F.col("_real").isNotNull() & (F.col("_na") != F.col("_real")), F.col("_na"))).over(run)})
    df = df.withColumns({"_st": F.min(F.when(F.col("confidence") < L.FLIP_CONFIDENCE, F.col("_rn"))).over(island), "_en": F.max("_rn").over(island)})
    df = df.withColumn("_sc", F.max(F.when(F.col("_rn") == F.col("_st"), F.coalesce("scene_characters", F.array().cast("array<string>")))).over(island))
    at_home = (F.size("_sc") == 0) | (F.array_contains("_sc", F.col("_p")) & F.array_contains("_sc", F.col("speaker")))
    long_ = F.col("_en") - F.col("_st") + 1 >= 3
    inside = (F.col("_rn") > F.col("_st")) & (F.col("_rn") < F.col("_en")) & (F.col("confidence") < L.FLIP_CONFIDENCE)
    hit = _known("speaker") & long_ & inside & (F.col("_p") == F.col("_n")) & at_home
    out = _apply(df, hit, L.FLIP_PENALTY, F.concat(F.lit("连续轮替修正 → "), F.col("_p")), speaker=F.col("_p"), attribution_type=F.lit("implicit"))
    return out.drop("_rn", "_low", "_ls", "_ll", "_isl", "_real", "_pb", "_na", "_begin", "_run", "_p", "_n", "_st", "_en", "_sc")


def unknown(df: DataFrame) -> DataFrame:
    hit = F.col("speaker").isin("未知", "旁白") & (F.col("confidence") <= 0.5)
    return df.withColumn("confidence", F.when(hit, _clamp(F.least(F.col("confidence"), F.lit(0.35)))).otherwise(F.col("confidence")))


def fix_consistency(segments: DataFrame, narrator: str | None = None, passes=PASSES) -> DataFrame:
    """segments (doc_id, seq, speaker, confidence, evidence, attribution_type, scene_characters, context_before, …) with the
    chosen passes applied in order."""
    steps = {"scene": lambda d: scene(d, narrator), "addressee": addressee, "jump": jump, "repeat": repeat, "alternation": alternation, "unknown": unknown}
    for name in PASSES:
        if name in passes:
            segments = steps[name](segments)
    return segments
