"""Column functions: normalisation, clauses, names, styles and speech units. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..sources import html
from . import lexicon as L


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def let(value, body) -> Column:
    """body(value) with the value worked out once a row, wherever body names it and however projections are merged."""
    return F.element_at(F.transform(F.array(col(value)), body), 1)


def strip(c) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(col(c), F.lit(L.WHITE_SPACE))


def lstrip(c) -> Column:
    return F.ltrim(col(c), F.lit(L.WHITE_SPACE))


def normalize_text(c) -> Column:
    """Quote marks of all kinds (book-title marks too) become corner brackets; blanks and blank lines collapse."""
    x = F.translate(F.replace(F.coalesce(col(c), F.lit("")), F.lit("\ufeff"), F.lit("")), "“”『』《》", "「」「」「」")
    x = F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n"))


def tts_cleanup(c) -> Column:
    """Brackets that a voice cannot read are replaced, in this order; lines without an end mark get one.

    The line end is looked for first: a pattern that begins with any character but end marks tries each character of a text. As
    a match takes the next line's first character with it, no match follows at once after one (\\G).
    """
    x = F.replace(F.coalesce(col(c), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    for source, target in (("【", "“"), ("】", "”"), ("（", "，"), ("）", "，"), ("[", "【"), ("]", "】")):
        x = F.replace(x, F.lit(source), F.lit(target))
    x = F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), "\n(?<![\n。！？!?；;：:]\n)(?<!\\G\n)([^\n])", "。\n$1")
    return strip(x)


def _shield(i: int) -> str:
    """What stands for a preserved token while rules run: private-use marks that no rule names."""
    return f"\ue000PRESERVE_{i}\ue001"


def preprocess(c, rules=None, preserved=None, steps=L.PREPROCESS_STEPS) -> tuple[Column, dict[str, Column]]:
    """HTML entities, then ordered rules by falling priority (stable), on text whose preserved tokens are shielded; hits per
    rule count on the text as earlier rules left it. Only the enabled steps run."""
    rules = sorted(L.DEFAULT_RULES if rules is None else rules, key=lambda r: -r[4]) if "apply_ordered_rules" in steps else []
    preserved = L.PRESERVED if preserved is None else preserved
    x, hits = F.coalesce(col(c), F.lit("")), {}
    for i, token in enumerate(preserved):
        x = F.replace(x, F.lit(token), F.lit(_shield(i)))
    if "html_unescape" in steps:
        # only texts with an ampersand travel to Python
        x = F.coalesce(html.html_unescape(F.when(F.contains(x, F.lit("&")), x)), x)
    for rule, kind, source, target, _ in rules:
        if kind == "regex":
            hits[rule] = F.regexp_count(x, F.lit(source)).cast("long")
            x = F.regexp_replace(x, source, target)
        else:
            hits[rule] = ((F.length(x) - F.length(F.replace(x, F.lit(source), F.lit("")))) / len(source)).cast("long")
            x = F.replace(x, F.lit(source), F.lit(target))
    for i, token in enumerate(preserved):
        x = F.replace(x, F.lit(_shield(i)), F.lit(token))
    return strip(F.replace(x, F.lit("\r\n"), F.lit("\n"))), hits


def preprocess_steps(df, c, rules=None, preserved=None, steps=L.PREPROCESS_STEPS):
    """(df with helper columns, the cleaned text, a struct of what was done) over a text column of df.

    The text after entities is a column of its own; a rule's count and its replacement then are one fold over the array of
    rules, so neither the text nor the plan is repeated for each rule. The struct has applied, original_chars,
    processed_chars, html_unescape_changed and rule_hits (id and count of the rules that hit).
    """
    rules = sorted(L.DEFAULT_RULES if rules is None else rules, key=lambda r: -r[4]) if "apply_ordered_rules" in steps else []
    preserved = L.PRESERVED if preserved is None else preserved
    raw = F.coalesce(col(c), F.lit(""))
    shielded = raw
    for i, token in enumerate(preserved):
        shielded = F.replace(shielded, F.lit(token), F.lit(_shield(i)))
    out = df.withColumn("_shielded", shielded)
    decoded = F.coalesce(html.html_unescape(F.when(F.contains("_shielded", F.lit("&")), F.col("_shielded"))), F.col("_shielded")) if "html_unescape" in steps else F.col("_shielded")
    out = out.withColumn("_decoded", decoded)
    kind = "struct<text:string,hits:array<struct<id:string,count:bigint>>>"
    table = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(k == "regex").alias("regex"), F.lit(s).alias("source"), F.lit(t).alias("target")) for i, k, s, t, _ in rules]) if rules else None

    def step(acc, r):
        count = F.when(r["regex"], F.regexp_count(acc["text"], r["source"])).otherwise(F.floor((F.length(acc["text"]) - F.length(F.replace(acc["text"], r["source"], F.lit("")))) / F.length(r["source"])))
        new = F.when(r["regex"], F.regexp_replace(acc["text"], r["source"], r["target"])).otherwise(F.replace(acc["text"], r["source"], r["target"]))
        # most texts hold few of the sources: one byte search tells, before anything is counted
        seen = F.when(r["regex"] | F.contains(acc["text"], r["source"]), count.cast("long")).otherwise(0)
        return let(seen, lambda n: F.when(n > 0, F.struct(new.alias("text"), F.concat(acc["hits"], F.array(F.struct(r["id"].alias("id"), n.alias("count")))).alias("hits")).cast(kind)).otherwise(acc))

    begun = F.struct(F.col("_decoded").alias("text"), F.array().cast("array<struct<id:string,count:bigint>>").alias("hits")).cast(kind)
    out = out.withColumn("_ruled", F.aggregate(table, begun, step) if rules else begun)
    text = F.col("_ruled.text")
    for i, token in enumerate(preserved):
        text = F.replace(text, F.lit(_shield(i)), F.lit(token))
    out = out.withColumn("_cleaned", strip(F.replace(text, F.lit("\r\n"), F.lit("\n"))))
    info = F.struct(
        (F.col("_cleaned") != strip(raw)).alias("applied"), F.length(raw).alias("original_chars"), F.length("_cleaned").alias("processed_chars"),
        (F.col("_decoded") != F.col("_shielded")).alias("html_unescape_changed"), F.col("_ruled.hits").alias("rule_hits"),
    )
    return out, F.col("_cleaned"), info


def html_unescape(c) -> Column:
    """The named entities of common use and decimal references up to two bytes; see sources.html for the whole table."""
    x = col(c)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def component(c, fallback: str = "item") -> Column:
    """A safe path component."""
    x = F.btrim(F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(fallback))


def fullmatch(c, pattern: str) -> Column:
    return col(c).rlike(rf"\A(?:{pattern})\z")


def clean_narration(c) -> Column:
    """Narration between quotes: nothing of it stays if it only joins quotes or only says who speaks."""
    x = strip(F.regexp_replace(strip(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", " "))
    sentences = F.regexp_extract_all(x, F.lit("[^。！？!?]*[。！？!?]|[^。！？!?]+"), F.lit(0))
    whole = F.transform(sentences, lambda s: F.concat(strip(F.regexp_replace(s, "[。！？!?]$", "")), F.regexp_extract(s, "([。！？!?])$", 1)))
    kept = F.filter(whole, lambda s: ~s.rlike(r"\A[。！？!?]?\z") & ~fullmatch(s, L.CUE_ONLY))
    rebuilt = strip(F.array_join(kept, " "))
    only_joins = (F.length(x) <= 2) & fullmatch(x, L.MICRO_CONNECTOR)
    none_kept = F.when(x.rlike(rf"\A(?:{L.CUE_ONLY})\z"), "").otherwise(x)
    return F.when((x == "") | only_joins | fullmatch(x, L.CUE_ONLY), "").when(F.size(kept) > 0, rebuilt).otherwise(none_kept)


def last_clause(c, limit: int = 48) -> Column:
    return strip(F.element_at(F.split(F.right(col(c), F.lit(limit)), "[。！？!?\n]", -1), -1))


def first_clause(c, limit: int = 48) -> Column:
    """The first clause, or nothing if another quote opens before it ends."""
    chunk = F.left(col(c), F.lit(limit))
    head = F.element_at(F.split(chunk, "[。！？!?\n]", -1), 1)
    return F.when(F.instr(head, "「") > 0, "").otherwise(strip(head))


def last_sentence(c) -> Column:
    parts = F.filter(F.transform(F.split(strip(c), "[。！？!?\n]", -1), strip), lambda s: s != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))


def canonical(c, aliases) -> Column:
    x = strip(F.coalesce(col(c), F.lit("")))
    return F.coalesce(F.try_element_at(col(aliases), x), x)


def known_names(aliases) -> Column:
    return F.array_sort(F.array_distinct(F.map_values(col(aliases))))


def match_names(aliases) -> Column:
    """Names of more than one character, longest first, then by name."""
    names = F.filter(F.array_union(F.map_keys(col(aliases)), F.map_values(col(aliases))), lambda n: F.length(n) > 1)
    return F.transform(F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda s: s["n"])


def _cut(x: Column, markers: str) -> Column:
    """What stands before the first of the marker characters."""
    return F.regexp_extract(x, f"^[^{markers}]*", 0)


def _drop_suffixes(x: Column, suffixes, keep_one: bool = True) -> Column:
    """A fold over the suffixes, in order; a name is not cut to nothing if keep_one says so."""
    least = 1 if keep_one else 0
    return F.aggregate(strings(suffixes), x, lambda acc, s: F.when(F.endswith(acc, s) & (F.length(acc) >= F.length(s) + least), F.left(acc, F.length(acc) - F.length(s))).otherwise(acc))


def _drop_prefixes(x: Column, prefixes) -> Column:
    return F.aggregate(strings(prefixes), x, lambda acc, p: F.when(F.startswith(acc, p), F.substring(acc, F.length(p) + 1, F.length(acc))).otherwise(acc))


def best_known_name(raw, aliases, names) -> Column:
    """The known name that a raw match begins with (longest first), else what is left without markers and actions."""
    x = F.btrim(F.coalesce(col(raw), F.lit("")), F.lit(" ，,。:："))
    first = F.try_element_at(F.filter(col(names), lambda n: F.startswith(x, n)), F.lit(1))
    cut = _drop_suffixes(_cut(x, "对向冲"), L.SPEAKER_SUFFIXES)
    second = F.try_element_at(F.filter(col(names), lambda n: F.startswith(cut, n) | F.endswith(cut, n)), F.lit(1))
    return canonical(F.coalesce(first, second, cut), aliases)


def candidate_name(raw, aliases) -> Column:
    x = F.btrim(F.coalesce(col(raw), F.lit("")), F.lit(" ，,。:："))
    x = _drop_suffixes(_cut(_drop_prefixes(x, L.DIRTY_PREFIXES), "对向冲从"), ["齐声", "一齐", "同时"], keep_one=False)
    return canonical(_drop_suffixes(x, L.CANDIDATE_SUFFIXES), aliases)


def plausible(name) -> Column:
    n = col(name)
    return (n != "") & ~n.isin(L.STOP_CANDIDATES) & (F.length(n) <= 8) & ~n.rlike("|".join(L.DIRTY_FRAGMENTS))


def short_forms(role) -> Column:
    """The name, its last two characters (from three on) and its last three (from four on)."""
    r = col(role)
    return F.filter(F.array(r, F.when(F.length(r) >= 3, F.right(r, F.lit(2))), F.when(F.length(r) >= 4, F.right(r, F.lit(3)))), lambda s: s.isNotNull())


def rfind(text, piece) -> Column:
    """0-based last position, -1 if absent."""
    t, p = col(text), col(piece)
    back = F.call_function("instr", F.reverse(t), F.reverse(p))
    return F.when(back > 0, F.length(t) - back - F.length(p) + 1).otherwise(-1)


def find(text, piece) -> Column:
    return F.call_function("instr", col(text), col(piece)) - 1


def normalize_style(c) -> Column:
    items = F.transform(F.split(col(c), ",", -1), lambda s: F.lower(strip(s)))
    kept = F.array_distinct(F.filter(items, lambda s: F.array_contains(strings(L.STYLE_ITEMS), s)))
    return F.nullif(F.array_join(kept, ", "), F.lit(""))


def gender(speaker) -> Column:
    s = strip(F.coalesce(col(speaker), F.lit("")))
    return F.when(s.isin("", "旁白", "UNKNOWN"), "unknown").when(F.exists(strings(L.FEMALE_NAMES), lambda n: F.contains(s, n)), "female").when(F.exists(strings(L.MALE_NAMES), lambda n: F.contains(s, n)), "male").otherwise("unknown")


def fallback_style(speaker, emotion) -> Column:
    hard = col(emotion).isin("cold", "serious", "angry")
    return F.when(col(speaker).isin("旁白", "UNKNOWN"), "female, moderate pitch").when(gender(speaker) == "female", "female, young adult, moderate pitch").when(hard, "male, low pitch").otherwise("male, young adult, moderate pitch")


def style_with_gender(style, speaker, emotion) -> Column:
    s, g = strip(F.coalesce(col(speaker), F.lit(""))), gender(speaker)
    parts = F.split(normalize_style(style), ", ")
    forced = F.when(g.isin("female", "male"), F.concat(F.array(g), F.filter(parts, lambda p: ~p.isin("female", "male")))).otherwise(parts)
    pitched = F.when(F.exists(forced, lambda p: p.isin(L.PITCH_ITEMS)), forced).otherwise(F.concat(forced, strings(["moderate pitch"])))
    return F.when(s.isin("旁白", "UNKNOWN"), "female, moderate pitch").when(normalize_style(style).isNull(), fallback_style(speaker, emotion)).otherwise(F.array_join(F.array_distinct(pitched), ", "))


def confidence_label(c) -> Column:
    x = col(c)
    return F.when(x.isNull(), "").when(x >= 0.85, "high").when(x >= 0.70, "medium").otherwise("low")


def chapter_key(c) -> Column:
    return strip(F.substring_index(col(c), " - ", 1))


def speech_units(c) -> dict[str, Column]:
    x = F.coalesce(col(c), F.lit(""))
    count = lambda p: F.regexp_count(x, F.lit(p)).cast("long")
    return {"cjk_chars": count(L.CJK), "latin_words": count(L.LATIN_WORD), "pauses": count(L.PAUSES)}


def lyric_line(speaker, text) -> Column:
    s, t = strip(F.coalesce(col(speaker), F.lit(""))), strip(F.coalesce(col(text), F.lit("")))
    return F.when((t == "") | s.isin("", L.NARRATOR), t).otherwise(F.concat(s, F.lit("："), t))


def voice_name(c) -> Column:
    """Lower case, without a trailing desktop mark, blanks collapsed."""
    return F.regexp_replace(F.replace(F.lower(strip(F.coalesce(col(c), F.lit("")))), F.lit(" desktop"), F.lit("")), r"\s+", " ")


def voice_style(sex, locale) -> Column:
    """The style tags of a catalogue voice."""
    s, l = F.lower(strip(F.coalesce(col(sex), F.lit("")))), strip(F.coalesce(col(locale), F.lit("")))
    accent = F.when(l == "zh-CN", "chinese accent").when(l == "ja-JP", "japanese accent").when(l == "en-US", "english accent")
    return F.concat_ws(", ", F.when(s.isin("female", "male"), s), accent, F.lit("moderate pitch"))


def speech_rate(style) -> Column:
    """One step faster for the young, one slower for the old."""
    s = F.lower(F.coalesce(col(style), F.lit("")))
    return s.rlike("child|teenager|young adult").cast("int") - F.contains(s, F.lit("elderly")).cast("int")
