"""Sources and sinks: texts, hints, segment files, clips, voice uploads, timelines, manifests, archives, audit tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import lexicon as L
from ..functions.text import col, component, confidence_label, let, strip, voice_name, voice_style

SEGMENT = "speaker string, text string, emotion string, style string, ref_audio string, ref_text string, voice_engine string, voice_name string, voice_locale string, cfg_value double, inference_timesteps int"
EXPORT = [
    "quote_id", "speaker", "text", "emotion", "style", "ref_audio", "ref_text", "voice_engine", "voice_name", "voice_locale", "cfg_value", "inference_timesteps",
    "addressee", "confidence", "evidence", "attribution_type", "candidates", "candidate_sources", "scene_characters", "context_before", "context_after",
]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document a file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_hints(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object (name -> alias or aliases) or array of names -> canonical, aliases. Anything else is an error."""
    raw = spark.read.text(path, wholetext=True).select(strip("value").alias("j"))
    return raw.select(F.explode(hints_of(F.col("j"))).alias("h")).select("h.canonical", "h.aliases")


def hints_of(json_text) -> Column:
    j = col(json_text)
    as_map = F.from_json(j, "map<string,string>")
    names = F.transform(F.from_json(j, "array<string>"), lambda n: F.struct(n.alias("canonical"), F.array().cast("array<string>").alias("aliases")))
    listed = lambda v: F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>")).otherwise(F.array(v))
    pairs = F.transform(F.map_entries(as_map), lambda e: F.struct(e["key"].alias("canonical"), F.filter(F.coalesce(listed(e["value"]), F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != "")).alias("aliases")))
    return F.when(F.startswith(j, F.lit("{")), pairs).when(F.startswith(j, F.lit("[")), names).otherwise(F.raise_error(F.lit("role hints must be a JSON object or array")))


def import_segments(rows: DataFrame, text: str = "json") -> DataFrame:
    """rows (doc_id, JSON text): an object's `segments`, or an array -> doc_id, seq and the segment fields; else an error."""
    j = strip(text)
    items = F.when(F.startswith(j, F.lit("{")), F.from_json(j, f"segments array<struct<{SEGMENT.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>")["segments"]).when(F.startswith(j, F.lit("[")), F.from_json(j, f"array<struct<{SEGMENT.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>")).otherwise(F.raise_error(F.lit("segments must be a JSON object or array")))
    return rows.select("doc_id", F.posexplode(items).alias("pos", "s")).select("doc_id", (F.col("pos") + 1).alias("seq"), "s.*")


def export_segments(segments: DataFrame) -> DataFrame:
    """doc_id, seq, json: the export fields that are there, empty texts for missing ones that are shown, and the marks a
    reader sees (`_confidence`, `_evidence`, `_needs_review`)."""
    kinds = dict(segments.dtypes)
    blank = {"emotion": "neutral", "style": "", "voice_engine": "", "voice_name": "", "voice_locale": "", "attribution_type": ""}
    field = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(blank[c])).alias(c) if c in blank and kinds[c] == "string" else F.col(c)
    fields = [field(c) for c in EXPORT if c in segments.columns]
    marks = []
    if "confidence" in segments.columns:
        unsure = F.col("speaker").isin("未知", "UNKNOWN") | F.coalesce(F.col("confidence") < 0.5, F.lit(False))
        marks = [confidence_label("confidence").alias("_confidence"), unsure.alias("_needs_review")]
    if "evidence" in segments.columns:
        marks.append(F.coalesce("evidence", F.lit("")).alias("_evidence"))
    return segments.select("doc_id", "seq", F.to_json(F.struct(*fields, *marks)).alias("json"))


def restore_segments(rows: DataFrame) -> DataFrame:
    """The inverse of export_segments(): empty texts are nulls again, missing speakers are the narrator, missing confidences 1."""
    kinds = {"cfg_value": "double", "inference_timesteps": "int", "confidence": "double", "candidates": "array<string>", "scene_characters": "array<string>", "candidate_sources": "map<string,array<string>>"}
    parsed = rows.select("doc_id", "seq", F.from_json("json", ", ".join(f"{c} {kinds.get(c, 'string')}" for c in EXPORT)).alias("s")).select("doc_id", "seq", "s.*")
    default = {"speaker": "旁白", "text": "", "emotion": "neutral", "context_before": "", "context_after": ""}
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default[c])) if c in default else F.nullif(F.col(c), F.lit(""))
    new = {c: text(c) for c in EXPORT if c not in kinds} | {"confidence": F.coalesce("confidence", F.lit(1.0))}
    new |= {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("candidates", "scene_characters")} | {"candidate_sources": F.coalesce("candidate_sources", F.create_map().cast("map<string,array<string>>"))}
    return parsed.withColumns(new)


GOLD = "quote_id string, quote_text string, speaker string, addressee string, evidence string, attribution_type string, scene_characters array<string>, candidates array<string>, confidence double"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Labelled quotes, a JSON object a line; broken lines are left out."""
    return gold_of(spark.read.text(path), "value")


def gold_of(rows: DataFrame, text: str = "json") -> DataFrame:
    """The same from a text column; the other columns stay."""
    keep = [c for c in rows.columns if c != text]
    parsed = rows.select(*keep, F.from_json(text, GOLD).alias("g")).where("g.quote_id is not null and g.speaker is not null")
    return parsed.select(*keep, "g.*")


def read_rules(spark: SparkSession, path: str) -> tuple[list[tuple], list[str], list[str]]:
    """A rule profile: rules as (id, kind, source, target, priority), preserved tokens, enabled steps. Configuration, so it
    comes to the driver. A missing or broken profile gives the built-in one; rules without a source go."""
    schema = (
        "rules array<struct<id:string,match_type:string,source:string,target:string,priority:int>>, preserve array<string>, "
        "pipeline array<struct<id:string,action:string,enabled:boolean>>, _broken string"
    )
    try:
        found = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(path, multiLine=True).first()
    except AnalysisException:
        found = None
    if found is None or found["_broken"] is not None:
        return list(L.DEFAULT_RULES), list(L.PRESERVED), list(L.PREPROCESS_STEPS)
    rules = [(r["id"] or r["source"], (r["match_type"] or "literal").strip().lower(), r["source"], r["target"] or "", r["priority"] or 0) for r in found["rules"] or [] if r["source"]]
    steps = [p["action"].strip().lower() for p in found["pipeline"] or [] if p["action"] and p["enabled"] is not False]
    return rules, [t for t in found["preserve"] or [] if t], steps


#: Chunks that one turn of the walk follows; turns end with the file.
CHUNKS_A_TURN = 16


def wav_metadata(files: DataFrame) -> DataFrame:
    """binaryFile rows of PCM clips -> path, channels, sample_rate, frames, duration.

    The walk goes from chunk header to chunk header by their sizes, the pad byte behind an odd one included, until it has met
    the format and the data, wherever they stand. A data chunk that the file cuts short counts as far as the file goes. What is
    no RIFF WAVE file, or has no data, has no frames; without a sample rate the duration is 0.
    """
    content, state = F.col("content"), "struct<at:long,channels:int,sample_rate:long,bits:int,bytes:long,done:boolean>"
    size = F.octet_length("content").cast("long")
    digits = lambda at, n: F.hex(F.substring(content, (at + 1).cast("int"), F.lit(n)))
    little = lambda at, n: let(digits(at, n), lambda h: F.conv(F.concat(*[F.substring(h, i, 2) for i in range(2 * n - 1, 0, -2)]), 16, 10).cast("long"))

    def step(s, _):
        at = s["at"]
        name, long_ = digits(at, 4), little(at + 4, 4)
        form, data = name == "666D7420", name == "64617461"

        def met(n):
            channels = F.when(form, little(at + 10, 2).cast("int")).otherwise(s["channels"])
            found = F.when(data & s["bytes"].isNull(), F.least(n, size - at - 8)).otherwise(s["bytes"])
            return F.struct(at + 8 + n + n % 2, channels, F.when(form, little(at + 12, 4)).otherwise(s["sample_rate"]), F.when(form, little(at + 22, 2).cast("int")).otherwise(s["bits"]), found, channels.isNotNull() & found.isNotNull()).cast(state)

        end = F.struct(s["at"], s["channels"], s["sample_rate"], s["bits"], s["bytes"], F.lit(True)).cast(state)
        return F.when(s["done"], s).when(at + 8 > size, end).otherwise(let(long_, met))

    def turn(s, _):
        return F.when(s["done"], s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(CHUNKS_A_TURN)), s, step))

    wave = (digits(F.lit(0), 4) == "52494646") & (digits(F.lit(8), 4) == "57415645")
    start = F.struct(F.lit(12), F.lit(None), F.lit(None), F.lit(None), F.lit(None), ~F.coalesce(wave, F.lit(False))).cast(state)
    turns = F.sequence(F.lit(1), F.ceil(size / (8 * CHUNKS_A_TURN)).cast("int") + 1)
    base = files.select("path", F.aggregate(turns, start, turn).alias("w")).select("path", "w.channels", "w.sample_rate", "w.bits", "w.bytes")
    wide = F.floor(F.col("channels") * F.col("bits") / 8)
    frames = F.when(wide > 0, F.floor(F.coalesce("bytes", F.lit(0).cast("long")) / wide)).otherwise(0)
    return base.withColumn("frames", frames).withColumn("duration", F.when(F.col("sample_rate") > 0, F.col("frames") / F.col("sample_rate")).otherwise(0.0)).drop("bytes", "bits")


def probe_files(wanted: DataFrame, listing: DataFrame, least: int = 100) -> DataFrame:
    """wanted (path) against a listing (path, length): exists, if the file has more than `least` bytes."""
    big = listing.where(F.col("length") > least).select("path", F.lit(True).alias("_there")).distinct()
    return wanted.join(big, "path", "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def decode_upload(name, data_url) -> tuple[Column, Column]:
    """A stable file name (stem, ten hex digits of the content, suffix) and the bytes of an upload with or without prefix."""
    d = col(data_url)
    raw = F.unbase64(F.when(F.instr(d, ",") > 0, F.regexp_extract(d, r"(?s)^[^,]*,(.*)$", 1)).otherwise(d))
    stem, suffix = F.regexp_replace(col(name), r"\.[^.]*$", ""), F.lower(F.regexp_extract(col(name), r"(\.[^.]*)$", 1))
    return F.concat(component(stem, "voice"), F.lit("_"), F.left(F.sha2(raw, 256), F.lit(10)), suffix), raw


def voice_catalogue(voices: DataFrame, locales: list[str]) -> DataFrame:
    """voices (name, locale, pos): wanted locales, the first of each (normalised name, lower locale)."""
    from pyspark.sql import Window

    key = F.lower(F.regexp_replace(F.regexp_replace(strip("name"), r"(?i)\s+desktop\b", ""), r"\s+", " "))
    keyed = voices.withColumns({"key": key, "_l": F.lower("locale")}).where(F.col("_l").isin([x.lower() for x in locales]))
    first = F.row_number().over(Window.partitionBy("key", "_l").orderBy("pos"))
    return keyed.withColumn("_n", first).where("_n = 1").drop("_n", "_l")


def base_url(c) -> Column:
    """Without trailing slashes, and ending in /v1."""
    x = F.rtrim(col(c), F.lit("/"))
    return F.when(F.endswith(x, F.lit("/v1")), x).otherwise(F.concat(x, F.lit("/v1")))


def absolute_url(base, url) -> Column:
    """A file's address below a base address; whole addresses and missing ones stay."""
    u, b = col(url), F.rtrim(strip(col(base)), F.lit("/"))
    return F.when(F.coalesce(u, F.lit("")) == "", u).when(u.rlike("^https?://"), u).otherwise(F.concat(b, F.lit("/"), F.ltrim(u, F.lit("/"))))


def voice_join(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """wanted (voice_name, …) with found, system_voice_name, voice_style of the catalogue's voice (name, locale, gender) of the
    same normalised name, the first of them by locale; a left join on a table of voices, which is small."""
    per = catalogue.groupBy(voice_name("name").alias("_k")).agg(F.min_by(F.struct("name", "locale", "gender"), F.struct("locale", "name")).alias("_v"))
    both = wanted.withColumn("_n", voice_name("voice_name")).join(per, F.col("_n") == F.col("_k"), "left")
    style = F.when(F.col("_v").isNotNull(), voice_style("_v.gender", "_v.locale"))
    return both.select(*wanted.columns, F.col("_v").isNotNull().alias("found"), F.col("_v.name").alias("system_voice_name"), style.alias("voice_style"))


def archive_name(base, idx) -> Column:
    return F.concat(component(base), F.format_string("_%03d.wav", col(idx)))


def write_jsonl(segments: DataFrame, path: str) -> None:
    """A JSON line a segment."""
    segments.write.json(path)


def as_objects(segments: DataFrame) -> DataFrame:
    """doc_id, json: a document's segments as one object {"segments": [...]}, in order."""
    lines = export_segments(segments)
    return lines.groupBy("doc_id").agg(F.concat(F.lit('{"segments":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "json"))), lambda x: x["json"]), ","), F.lit("]}")).alias("json"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    shown = manifest.withColumn("duration_seconds", F.format_string("%.2f", "duration_seconds"))
    shown.write.option("sep", "\t").csv(path, header=True)


def write_lrc(lines: DataFrame, path: str) -> None:
    """One folder an output, lines in time order within its file."""
    lines.repartition("out").sortWithinPartitions("out", "idx").select("out", F.col("line").alias("value")).write.partitionBy("out").text(path)


def archive_layout(rows: DataFrame) -> DataFrame:
    """rows (day, name and, if present, category) -> the same with `area` and a safe `category`: names that begin with
    `preview_` are temporary and lie under their day, as `preview` unless they have a category; others are kept by name."""
    brief = F.startswith(F.lower(strip(F.coalesce("name", F.lit("")))), F.lit("preview_"))
    given = F.nullif(strip(F.coalesce("category", F.lit(""))), F.lit("")) if "category" in rows.columns else F.lit(None).cast("string")
    return rows.withColumns({"area": F.when(brief, "temp_by_date").otherwise("outputs"), "category": F.when(brief, component(F.coalesce(given, F.lit("preview")), "misc")).otherwise(component(F.coalesce(given, F.lit("named")), "misc"))})


def write_archive(rows: DataFrame, path: str) -> None:
    """Dated layout: a folder a day and category (and area, see archive_layout). A rerun replaces the folders that it writes and
    leaves the others."""
    folders = [c for c in ("area", "day", "category") if c in rows.columns]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def append_calls(calls: DataFrame, path: str) -> None:
    """The audit table of service calls."""
    calls.write.mode("append").parquet(path)
