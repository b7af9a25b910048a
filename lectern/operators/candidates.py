"""Candidate speakers of a quote, ranked by distance, and aliases inferred from titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon as L
from ..functions.text import candidate_name, canonical, col, find, known_names, plausible, rfind, short_forms, strings

CUE = f"({L.NAME})\\s*(?:{L.SPEECH_VERBS}|{L.ACTION_CUES})"
GROUP_CUE = f"({'|'.join(L.GROUP_NAMES)})\\s*(?:齐声|一齐|同时)?\\s*(?:{L.GROUP_CUE_VERBS})"


def _tagged(names: Column, source: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(source).alias("source")))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def generate_candidates(quotes: DataFrame, most: int = L.MAX_CANDIDATES, mentions: bool = False) -> DataFrame:
    """quotes with `aliases` (map alias -> canonical) and, if present, `recent` (array), `entities` (names that an entity
    recogniser found) and `narrator` -> the same rows with candidates, candidate_sources, scene_characters.

    Names come, in this order, from hints seen in the context, recent speakers, group cues and, without hints only, from cue
    phrases and titles, then from the recogniser. With hints but no real name, all recent speakers and all hints are taken.
    Order: distance to the quote, then more mentions, then first mention. Row-local: nothing is shuffled. With `mentions`,
    a column of that name keeps all admitted names with their sources, repeats included.
    """
    have = set(quotes.columns)
    recent = F.coalesce("recent", strings([])) if "recent" in have else strings([])
    entities = F.coalesce("entities", strings([])) if "entities" in have else strings([])
    narrator = F.col("narrator") if "narrator" in have else F.lit(None).cast("string")
    context = F.concat("context_before", F.lit("\n"), "context_after")
    known, hinted = known_names("aliases"), F.size("aliases") > 0
    seen = F.filter(known, lambda r: F.exists(short_forms(r), lambda f: F.contains(context, f)))
    late = F.when(F.size(recent) > L.RECENT, F.slice(recent, F.lit(-L.RECENT), F.lit(L.RECENT))).otherwise(recent)
    cues = F.when(hinted, F.array().cast("array<struct<name:string,source:string>>")).otherwise(F.concat(_tagged(F.transform(_matches(context, CUE), lambda n: candidate_name(n, "aliases")), "rule_cue"), _tagged(_matches(context, f"({L.TITLES})"), "title")))
    raw = F.concat(_tagged(seen, "role_hints"), _tagged(late, "recent_speakers"), _tagged(_matches(context, GROUP_CUE), "group_cue"), cues, _tagged(F.transform(entities, lambda n: candidate_name(n, "aliases")), "entities"))
    step1 = quotes.withColumns({"_raw": raw, "_recent": recent, "_narrator": narrator, "_known": known})

    def admitted(names: Column) -> Column:
        clean = F.transform(names, lambda x: F.struct(canonical(x["name"], "aliases").alias("name"), x["source"].alias("source")))
        free = lambda n: (F.size("aliases") == 0) | n.isin(L.FALLBACK_CANDIDATES + L.GROUP_NAMES) | F.array_contains("_known", n)
        return F.filter(clean, lambda x: free(x["name"]) & plausible(x["name"]))

    step2 = step1.withColumn("_names", admitted(F.col("_raw")))
    if mentions:
        step2 = step2.withColumn("mentions", F.col("_names"))
    real = F.filter("_names", lambda x: ~x["name"].isin(L.FALLBACK_CANDIDATES + L.GROUP_NAMES))
    bare = (F.size("aliases") > 0) & (F.size(real) == 0)
    wide = F.concat("_names", admitted(F.concat(_tagged(F.col("_recent"), "recent_speakers_extended"), _tagged(F.col("_known"), "role_hints_fallback"))))
    step3 = step2.withColumns({"_names": F.when(bare, wide).otherwise(F.col("_names")), "_most": F.when(bare, F.greatest(F.lit(most), F.size("_known") + 2)).otherwise(most)})
    anchor = F.col("_narrator").isNotNull() & (F.col("_narrator") != "") & ~F.exists("_names", lambda x: x["name"] == F.col("_narrator"))
    step4 = step3.withColumn("_names", F.when(anchor, F.concat("_names", F.array(F.struct(F.col("_narrator").alias("name"), F.lit("narrator_anchor").alias("source"))))).otherwise(F.col("_names")))

    def distance(name: Column) -> Column:
        before, after = rfind("context_before", name), find("context_after", name)
        return F.least(F.when(before >= 0, F.length("context_before") - before).otherwise(10_000), F.when(after >= 0, after).otherwise(10_000))

    distinct = F.array_distinct(F.transform("_names", lambda x: x["name"]))
    keyed = F.transform(distinct, lambda n, i: F.struct(distance(n).alias("d"), (-F.size(F.filter("_names", lambda x: x["name"] == n))).alias("c"), i.alias("i"), n.alias("n")))
    ordered = F.transform(F.array_sort(keyed), lambda s: s["n"])
    step5 = step4.withColumn("candidates", F.slice(F.array_distinct(F.concat(ordered, strings(L.FALLBACK_CANDIDATES))), F.lit(1), F.col("_most")))
    tags = lambda n: F.array_distinct(F.transform(F.filter("_names", lambda x: x["name"] == n), lambda x: x["source"]))
    sources = F.map_from_entries(F.transform("candidates", lambda n: F.struct(n, F.when((F.size(tags(n)) == 0) & n.isin(L.FALLBACK_CANDIDATES), strings(["fallback"])).otherwise(tags(n)))))
    scene = F.filter("candidates", lambda n: ~n.isin(L.FALLBACK_CANDIDATES))
    return step5.withColumns({"candidate_sources": sources, "scene_characters": scene}).drop("_raw", "_recent", "_narrator", "_known", "_names", "_most")


def alias_map(hints) -> Column:
    """array<struct<canonical, aliases>> -> map alias -> canonical; later entries win; skip names are no aliases."""
    one = lambda h: F.transform(F.concat(F.array(h["canonical"]), F.coalesce(h["aliases"], strings([]))), lambda a: F.struct(F.btrim(a).alias("alias"), F.btrim(h["canonical"]).alias("canonical")))
    entries = F.filter(F.flatten(F.transform(F.coalesce(col(hints), F.array().cast("array<struct<canonical:string,aliases:array<string>>>")), one)), lambda e: (e["alias"] != "") & (e["canonical"] != "") & ~e["alias"].isin(L.ALIAS_SKIP_NAMES))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda l: l["alias"] == e["alias"]))
    return F.map_from_entries(last)


def infer_aliases(names: DataFrame) -> DataFrame:
    """doc_id, aliases (map), observed (array of names) -> doc_id, inferred (map), aliases (map with all).

    A titled name goes to the one canonical name that begins with its surname; observed names become their own aliases.
    """
    fresh = F.filter(F.array_distinct(F.transform("observed", F.btrim)), lambda n: ~n.isin(L.ALIAS_SKIP_NAMES))
    own = F.filter(fresh, lambda n: ~F.map_contains_key("aliases", n))
    base = names.withColumns({"_fresh": fresh, "_own": own})
    base = base.withColumn("_canon", F.filter(F.array_distinct(F.concat(F.map_values("aliases"), "_own")), lambda n: F.length(n) > 1))
    suffix = lambda n: F.try_element_at(F.filter(strings(L.ALIAS_TITLE_SUFFIXES), lambda s: F.endswith(n, s) & (F.length(n) > F.length(s))), F.lit(1))
    open_ = F.filter("_fresh", lambda n: (F.coalesce(F.try_element_at("aliases", n), n) == n) & suffix(n).isNotNull())
    fits = lambda n: F.filter("_canon", lambda c: (c != n) & F.startswith(c, F.left(n, F.length(n) - F.length(suffix(n)))))
    found = F.map_from_entries(F.transform(F.filter(open_, lambda n: F.size(fits(n)) == 1), lambda n: F.struct(n, F.element_at(fits(n), 1))))
    done = base.withColumn("inferred", found)
    merged = F.map_concat(F.map_filter("aliases", lambda k, v: ~F.map_contains_key("inferred", k)), F.map_from_entries(F.transform(F.filter("_own", lambda n: ~F.map_contains_key("inferred", n)), lambda n: F.struct(n, n))), F.col("inferred"))
    return done.select("doc_id", "inferred", merged.alias("aliases"))


def canonicalize(rows: DataFrame, aliases: DataFrame, name: str = "speaker") -> DataFrame:
    """Left lookup of `name` in aliases (doc_id, alias, canonical); the name itself where there is none; not transitive."""
    lookup = aliases.select(F.col("doc_id").alias("_d"), F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    return rows.join(lookup, (rows["doc_id"] == F.col("_d")) & (rows[name] == F.col("_a")), "left").withColumn(name, F.coalesce("_c", name)).drop("_d", "_a", "_c")


def observed_aliases(segments: DataFrame, groups: DataFrame) -> DataFrame:
    """groups (doc_id, canonical, alias): only aliases that were observed as speakers and differ from the canonical name."""
    seen = segments.select("doc_id", F.col("speaker").alias("alias")).where(~F.col("alias").isin(L.REGISTRY_SKIP)).distinct()
    return groups.where("alias <> canonical").join(seen, ["doc_id", "alias"], "left_semi").select("doc_id", "alias", "canonical").distinct()
