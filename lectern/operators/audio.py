"""Speech planning: duration bounds, validation, profiles, lyric timelines, volumes. Synthesis itself is outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import lexicon as L
from ..functions.text import col, lyric_line, speech_units


def duration_bounds(rows: DataFrame, text: str = "text", digits: int | None = 3) -> DataFrame:
    """rows with cjk_chars, latin_words, pauses, units, enabled, estimated_seconds, min_seconds, max_seconds (to `digits`
    places, unrounded with None)."""
    out = rows.withColumns(speech_units(text)).withColumn("units", F.col("cjk_chars") + F.col("latin_words"))
    spoken = F.col("cjk_chars") / L.CJK_PER_SECOND + F.col("latin_words") / L.WORDS_PER_SECOND
    estimate = F.greatest(F.lit(L.LEAST_SECONDS), spoken + F.least(F.col("pauses") * L.PAUSE_SECONDS, spoken * L.PAUSE_SHARE))
    enabled = F.col("units") >= L.LEAST_UNITS
    rounded = lambda c: F.when(enabled, c if digits is None else F.round(c, digits)).otherwise(0.0)
    return out.withColumns({"enabled": enabled, "estimated_seconds": rounded(estimate), "min_seconds": rounded(F.greatest(F.lit(L.LEAST_SECONDS), estimate * L.LEAST_RATIO)), "max_seconds": rounded(F.greatest(F.lit(L.MOST_SECONDS), estimate * L.MOST_RATIO + L.MOST_SLACK))})


def validate_durations(segments: DataFrame, inventory: DataFrame) -> DataFrame:
    """Clips (doc_id, seq, frames, sample_rate) against the bounds of their text: duration_seconds, valid."""
    clips = inventory.select("doc_id", "seq", F.when(F.col("sample_rate") > 0, F.col("frames") / F.col("sample_rate")).otherwise(0.0).alias("duration_seconds"))
    both = duration_bounds(segments.join(clips, ["doc_id", "seq"]))
    return both.withColumn("valid", ~F.col("enabled") | F.col("duration_seconds").between(F.col("min_seconds"), F.col("max_seconds")))


def synthesis_plan(segments: DataFrame, profiles: DataFrame) -> DataFrame:
    """Segments with the profile of their speaker filled in: own values first; no style where a reference clip is used."""
    fields = [c for c in ("style", "ref_audio", "ref_text", "voice_engine", "voice_name", "voice_locale", "cfg_value", "inference_timesteps") if c in profiles.columns]
    p = profiles.select("speaker", *[F.col(c).alias(f"_{c}") for c in fields])
    own = lambda c: F.nullif(F.col(c), F.lit("")) if dict(segments.dtypes).get(c) == "string" else F.col(c)
    joined = segments.join(p, "speaker", "left")
    filled = joined.withColumns({c: (F.coalesce(own(c), F.col(f"_{c}")) if c in segments.columns else F.col(f"_{c}")) for c in fields}).drop(*[f"_{c}" for c in fields])
    default = F.when(F.col("speaker").isin("旁白", "UNKNOWN"), "female, moderate pitch").otherwise("male, moderate pitch")
    return filled.withColumn("style", F.when(F.coalesce("ref_audio", F.lit("")) != "", F.lit(None).cast("string")).otherwise(F.coalesce("style", default)))


def backend_route(engine, ref_audio, voice) -> Column:
    """Which backend renders a segment, and for the cloning one which model."""
    e = F.lower(F.coalesce(col(engine), F.lit("")))
    clone = F.coalesce(col(ref_audio), F.lit("")) != ""
    return F.when(e.isin("microsoft", "voxcpm", "remote"), e).when(e == "mimo", F.when(clone, "mimo:clone").when(F.coalesce(col(voice), F.lit("")) != "", "mimo:voice").otherwise("mimo:design")).otherwise("local")


def _timeline(*keys):
    return Window.partitionBy(*keys).orderBy("idx")


def timestamp_text(seconds) -> Column:
    s = F.greatest(F.lit(0.0), col(seconds))
    minutes = F.floor(s / 60)
    return F.format_string("%02d:%05.2f", minutes, s - minutes * 60)


def lrc(clips: DataFrame, keys=("out",), silence_ms: int = L.SILENCE_MS) -> DataFrame:
    """clips (*keys, idx, duration, speaker, text) -> keys, idx, offset_seconds, line; blank texts give no line, but take time."""
    w = _timeline(*keys)
    before = F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    offset = before + (F.row_number().over(w) - 1) * (max(0, silence_ms) / 1000)
    timed = clips.withColumns({"offset_seconds": offset, "lyric": lyric_line("speaker", "text")})
    return timed.where("lyric <> ''").select(*keys, "idx", "offset_seconds", F.concat(F.lit("["), timestamp_text("offset_seconds"), F.lit("]"), "lyric").alias("line"))


def pack_volumes(clips: DataFrame, silence_ms: int = L.SILENCE_MS, most_bytes: int = L.VOLUME_BYTES, most_items: int = L.VOLUME_ITEMS, keep: tuple = ()) -> DataFrame:
    """clips (out, idx, frames, sample_rate, channels) -> out, idx, the columns of `keep`, volume (from 1).

    A left fold over the clips of one output with a three-number state. Clips are dealt by output and sorted by place, and the
    fold reads them batch by batch, so a task holds one batch besides its sort, which can spill.
    """
    size = (F.col("frames") * F.col("channels") * L.SAMPLE_BYTES).cast("long")
    gap = (F.floor(F.col("sample_rate") * max(0, silence_ms) / 1000) * F.col("channels") * L.SAMPLE_BYTES).cast("long")
    sized = clips.select("out", "idx", *keep, F.coalesce(size, F.lit(0)).cast("long").alias("_size"), F.coalesce(gap, F.lit(0)).cast("long").alias("_gap"))
    schema = StructType([*sized.schema.fields[:-2], StructField("volume", IntegerType())])

    def fold(batches):
        import pyarrow as pa

        begun, current, volume, n, filled = False, None, 1, 0, 0
        for batch in batches:
            volumes = []
            for out, own, joint in zip(batch.column("out").to_pylist(), batch.column("_size").to_pylist(), batch.column("_gap").to_pylist()):
                if not begun or out != current:
                    begun, current, volume, n, filled = True, out, 1, 0, 0
                ahead = filled + own + (joint if n else 0)
                if n and (n >= most_items or 0 < most_bytes < ahead):
                    volume, n, ahead = volume + 1, 0, own
                n, filled = n + 1, ahead
                volumes.append(volume)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(volumes, pa.int32())], names=schema.names)

    packed = sized.repartition("out").sortWithinPartitions("out", "idx").mapInArrow(fold, schema)
    return packed.select("out", "idx", *keep, "volume")


def require_one_format(clips: DataFrame) -> DataFrame:
    """clips as they are; an error if the clips of an output differ in sample rate or channels."""
    odd = clips.groupBy("out").agg(F.min("sample_rate").alias("r0"), F.max("sample_rate").alias("r1"), F.min("channels").alias("c0"), F.max("channels").alias("c1"))
    told = F.concat(F.lit("clips of output "), F.col("out").cast("string"), F.lit(" differ in format"))
    checked = odd.select(F.col("out").alias("_out"), F.when((F.col("r0") != F.col("r1")) | (F.col("c0") != F.col("c1")), F.raise_error(told)).otherwise(F.lit("one")).alias("_format"))
    # the joined mark is read, so the check is not pruned away
    return clips.join(checked, clips["out"] == F.col("_out")).where("_format = 'one'").select(*[clips[c] for c in clips.columns])


def volume_manifest(clips: DataFrame, volumes: DataFrame, silence_ms: int = L.SILENCE_MS) -> DataFrame:
    """out, volume, segments, start_index, end_index, duration_seconds, size_bytes of each volume (44 header bytes)."""
    return manifest_of(clips.join(volumes, ["out", "idx"]), silence_ms)


def manifest_of(packed: DataFrame, silence_ms: int = L.SILENCE_MS) -> DataFrame:
    """volume_manifest() of clips that carry their volume, as pack_volumes() gives them with `keep`: no join."""
    gap = max(0, silence_ms) / 1000
    return packed.groupBy("out", "volume").agg(
        F.count("*").alias("segments"), F.min("idx").alias("start_index"), F.max("idx").alias("end_index"),
        F.round(F.sum(F.col("frames") / F.col("sample_rate")) + (F.count("*") - 1) * gap, 2).alias("duration_seconds"),
        (F.sum(F.col("frames") * F.col("channels") * L.SAMPLE_BYTES) + (F.count("*") - 1) * F.max(F.floor(F.col("sample_rate") * gap) * F.col("channels") * L.SAMPLE_BYTES) + 44).cast("long").alias("size_bytes"),
    )


def volume_lrc(clips: DataFrame, volumes: DataFrame, silence_ms: int = L.SILENCE_MS) -> DataFrame:
    """Timelines of volumes; the clock restarts in each."""
    return lrc(clips.join(volumes, ["out", "idx"]), ("out", "volume"), silence_ms)
