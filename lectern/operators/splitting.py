"""Chapters, scenes, paragraphs, chunks and numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import lexicon as L
from ..functions.folds import emitted, grouped
from ..functions.lines import line_array, part_array, slice_array
from ..functions.spans import blocks, cut, spans
from ..functions.text import col, let, lstrip, normalize_text, preprocess_steps, strip


def split_chapters(docs: DataFrame) -> DataFrame:
    """doc_id, chapter_idx, title, content. Text before the first heading and empty chapters go; without any heading (or
    content below one) the document is one chapter 全文; an empty document has none."""
    text = docs.select("doc_id", normalize_text("text").alias("text")).where("text <> ''")
    return _between_headings(text, L.CHAPTER_LINE, strip)


def _between_headings(text: DataFrame, pattern: str, title) -> DataFrame:
    only = lambda t: F.array(F.struct(F.lit("全文").alias("title"), t.alias("content")))
    parts = let("text", lambda t: let(_chapters(t, spans(t, pattern), title), lambda ps: F.when(F.size(ps) > 0, ps).otherwise(only(t))))
    return text.select("doc_id", F.posexplode(parts).alias("chapter_idx", "p")).select("doc_id", "chapter_idx", "p.title", "p.content")


def _chapters(text: Column, heads: Column, title) -> Column:
    """array<struct<title, content>> between headings (an array of spans); empty chapters go."""

    def parts(hs, bs):
        upto = lambda i: F.coalesce(F.get(hs, i + 1)["start"], F.length(text))
        return F.filter(F.transform(hs, lambda h, i: F.struct(title(h["raw"]).alias("title"), strip(cut(bs, h["end"], upto(i))).alias("content"))), lambda p: p["content"] != "")

    return let(heads, lambda hs: let(blocks(text), lambda bs: parts(hs, bs)))


def _unmarked(raw: Column) -> Column:
    """A heading without its marks."""
    return strip(F.regexp_replace(strip(raw), r"\A#+", ""))


def heading_vote(docs: DataFrame) -> DataFrame:
    """doc_id, pattern, hits, score: the heading pattern with the greatest hits x weight of those that hit twice; the
    earlier pattern wins ties; `none` if none does."""
    counts = [F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(p)) for _, p, _ in L.HEADINGS]
    votes = F.filter(F.array(*[F.struct((c * w).alias("score"), F.lit(-i).alias("rank"), c.alias("hits"), F.lit(name).alias("pattern")) for i, ((name, _, w), c) in enumerate(zip(L.HEADINGS, counts))]), lambda v: v["hits"] >= 2)
    best = F.array_max(votes)
    return docs.select("doc_id", F.coalesce(best["pattern"], F.lit("none")).alias("pattern"), F.coalesce(best["hits"], F.lit(0)).alias("hits"), F.coalesce(best["score"], F.lit(0)).alias("score"))


def split_by_headings(docs: DataFrame, pattern: str) -> DataFrame:
    """Chapters at the headings of one voted pattern; titles lose their marks."""
    regex = next(p for n, p, _ in L.HEADINGS if n == pattern)
    return _between_headings(docs.select("doc_id", "text").where(F.regexp_count("text", F.lit(regex)) > 0), regex, _unmarked)


def scene_breaks(docs: DataFrame, prefix: str = "段落") -> DataFrame:
    """Parts between break lines; nothing for documents with fewer than two parts."""
    return docs.select("doc_id", F.posexplode(_scenes(F.col("text"), F.lit(prefix))).alias("chunk_idx", "p")).select("doc_id", "chunk_idx", "p.title", "p.content")


def _scenes(content: Column, title: Column) -> Column:
    """array<struct<title, content>>; null with fewer than two scenes."""
    parts = F.filter(F.transform(F.split(content, L.SCENE_BREAK, -1), strip), lambda p: p != "")
    return let(parts, lambda ps: F.when(F.size(ps) >= 2, F.transform(ps, lambda p, i: F.struct(F.concat(title, F.lit(" "), i + 1).alias("title"), p.alias("content")))))


def paragraphs(text) -> Column:
    return F.filter(F.transform(F.split(col(text), "\n\\s*\n", -1), strip), lambda p: p != "")


_STATE = "struct<g:int,n:int,size:int,shut:boolean>"


def group_numbers(sizes, most: int, joint: int = 0, target: int | None = None, most_items: int | None = None) -> Column:
    """array<int>: the group of each item of sizes (struct<len, may_end>), filled one after another.

    A group is full before an item that would take it beyond `most` (a joint counts `joint`) or `most_items`; with a target it
    also ends with the first item from there on that may end it.
    """

    def step(s, x):
        began = (s["n"] == 0) | s["shut"]
        beyond = s["size"] + x["len"] + joint > most
        fresh = ~began & (beyond if most_items is None else beyond | (s["n"] >= most_items))
        return let(began | fresh, lambda new: F.struct((s["g"] + (new & (s["n"] > 0)).cast("int")).alias("g"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.when(new, x["len"]).otherwise(s["size"] + x["len"] + joint).alias("size"), x["may_end"].alias("shut")))

    def ended(s, x):
        return let(step(s, x), lambda t: F.struct(t["g"], t["n"], t["size"], (t["shut"] & (t["size"] >= target) if target is not None else F.lit(False))))

    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(False).alias("shut"))
    return emitted(sizes, _STATE, start, ended, lambda s: s["g"])


def _sized(items: Column, may_end=lambda p: F.lit(False)) -> Column:
    return F.transform(items, lambda p: F.struct(F.length(p).alias("len"), may_end(p).alias("may_end")))


def _whole_turn(p: Column) -> Column:
    """A chunk may end with a paragraph that ends a speech, or is none."""
    return strip(p).rlike("[”\"」』]\\z") | ~lstrip(p).rlike("\\A[“\"「『]")


def _packed(content: Column, title: Column, target: int, most: int) -> Column:
    groups = let(paragraphs(content), lambda ps: grouped(ps, group_numbers(_sized(ps, _whole_turn), most, 2, target)))
    return F.transform(groups, lambda g, i: F.struct(F.concat(title, F.lit(" "), i + 1).alias("title"), F.array_join(g, "\n\n").alias("content")))


def pack_paragraphs(docs: DataFrame, target: int, most: int, prefix: str = "块") -> DataFrame:
    """Chunks of whole paragraphs: closed before `most` is passed, and from `target` on where no dialogue is cut open. A
    joint counts two characters."""
    rows = docs.select("doc_id", F.posexplode(_packed(F.col("text"), F.lit(prefix), target, most)).alias("chunk_idx", "p"))
    return rows.select("doc_id", "chunk_idx", F.col("p.title").alias("chunk_title"), "p.content")


def split_long_chunks(chunks: DataFrame, most: int) -> DataFrame:
    """chunks (doc_id, chunk_idx, title, content): longer ones are cut between paragraphs; joints count nothing."""

    def parts(content):
        groups = let(paragraphs(content), lambda ps: F.when(F.length(content) > most, grouped(ps, group_numbers(_sized(ps), most))).otherwise(F.array().cast("array<array<string>>")))
        named = lambda gs: F.transform(gs, lambda g, i: F.struct(F.concat("title", F.lit("（第"), i + 1, F.lit("部分）")).alias("title"), F.array_join(g, "\n\n").alias("content")))
        return let(groups, lambda gs: F.when(F.size(gs) > 0, named(gs)).otherwise(F.array(F.struct(F.col("title"), content.alias("content")))))

    return chunks.select("doc_id", "chunk_idx", F.posexplode(let("content", parts)).alias("part_idx", "p")).select("doc_id", "chunk_idx", "part_idx", "p.title", "p.content")


def number_lines(chunks: DataFrame, most: int = 160) -> DataFrame:
    """chunks (doc_id, chunk_idx, content) -> doc_id, chunk_idx, line_no, line_id, start, end, text.

    Offsets are those of `content`. Lines of more than `most` characters are cut at the first sentence end at or after them. A
    chunk is worked off in its row: no shuffle, and the text is not carried along.
    """
    rows = chunks.select("doc_id", "chunk_idx", line_array("content", most).alias("ls")).select("doc_id", "chunk_idx", F.posexplode("ls").alias("i", "l"))
    number = F.col("i") + 1
    return rows.select("doc_id", "chunk_idx", number.alias("line_no"), F.concat(F.lit("L"), number).alias("line_id"), "l.start", (F.col("l.start") + F.length("l.text")).alias("end"), "l.text")


def line_budget(lines: DataFrame, most_chars: int, most_lines: int) -> DataFrame:
    """Which part of its chunk a line falls into: lines fill a part until it has most_lines or would pass most_chars. Only
    lengths are collected, a chunk at a time."""
    sized = lines.select("doc_id", "chunk_idx", F.struct("line_no", F.greatest(F.lit(1), F.length("text")).alias("s")).alias("l"))
    per = sized.groupBy("doc_id", "chunk_idx").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    packed = per.select("doc_id", "chunk_idx", part_array(F.transform("ls", lambda x: x["s"]), most_chars, most_lines).alias("parts"))
    return packed.select("doc_id", "chunk_idx", F.posexplode("parts").alias("pos", "part")).select("doc_id", "chunk_idx", (F.col("pos") + 1).alias("line_no"), "part")


def _slice_title(part: Column) -> Column:
    return F.concat("title", F.lit("（第"), part + 1, F.lit("部分）"))


def line_slices(chunks: DataFrame, most_chars: int, most_lines: int, inherited: str | None = None) -> DataFrame:
    """chunks (doc_id, chunk_idx, title, content) -> doc_id, chunk_idx, part, title, content, line_ids, numbered_text: the
    parts of line_budget() as slices of the chunk's own text, cut in its row: no shuffle.

    `inherited` names an array column of line ids from an earlier cut; they are kept where there is one a line.
    """
    kept = [inherited] if inherited else []
    cuts = chunks.select("doc_id", "chunk_idx", "title", *kept, slice_array("content", most_chars, most_lines).alias("ss"))
    rows = cuts.select("doc_id", "chunk_idx", "title", *kept, F.try_element_at("ss", F.lit(-1))["last"].alias("n"), F.posexplode("ss").alias("part", "s"))
    numbers = F.sequence(F.col("s.first"), F.col("s.last"))
    ids = F.transform(numbers, lambda i: F.concat(F.lit("L"), i))
    if inherited:
        ids = F.when(F.size(inherited) == F.col("n"), F.transform(numbers, lambda i: F.get(inherited, i - 1))).otherwise(ids)
    return rows.select("doc_id", "chunk_idx", "part", _slice_title(F.col("part")).alias("title"), "s.content", ids.alias("line_ids"), F.col("s.shown").alias("numbered_text"))


def slice_long_chunks(chunks: DataFrame, most_chars: int, most_lines: int) -> DataFrame:
    """chunks (doc_id, chunk_idx, title, content) -> doc_id, chunk_idx, part, title, content: line_slices() of the chunks whose
    numbered text passes most_chars or has most_lines; the others stay, as part 0. No shuffle."""
    cuts = chunks.select("doc_id", "chunk_idx", "title", "content", slice_array("content", most_chars, most_lines).alias("ss"))
    # a shown part lacks one line end
    shown = F.aggregate("ss", F.lit(0), lambda a, s: a + F.length(s["shown"]) + 1)
    long_ = F.coalesce((F.try_element_at("ss", F.lit(-1))["last"] >= most_lines) | (shown > most_chars), F.lit(False))
    sliced = F.transform("ss", lambda s, i: F.struct(i.alias("part"), _slice_title(i).alias("title"), s["content"].alias("content")))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.col("title"), F.col("content")))
    return cuts.select("doc_id", "chunk_idx", F.explode(F.when(long_, sliced).otherwise(whole)).alias("p")).select("doc_id", "chunk_idx", "p.*")


def coerce_chunks(rows: DataFrame, replies: str = "response", title: str = "title") -> DataFrame:
    """rows with a JSON array of {title, content} objects -> the other columns, part_no, title, content: blank contents go,
    a missing title is named after the `title` column and its place."""
    item = "array<struct<title:string,content:string>>"
    keep = [c for c in rows.columns if c not in (replies, title)]
    found = rows.select(*keep, F.col(title).alias("_t"), F.posexplode(F.from_json(replies, item)).alias("i", "c"))
    name = F.concat(F.col("_t"), F.lit(" - 第"), F.col("i") + 1, F.lit("块"))
    given = F.nullif(strip(F.coalesce("c.title", F.lit(""))), F.lit(""))
    clean = found.select(*keep, "i", F.coalesce(given, name).alias("title"), strip(F.coalesce("c.content", F.lit(""))).alias("content")).where("content <> ''")
    place = F.row_number().over(Window.partitionBy(*keep).orderBy("i"))
    return clean.select(*keep, place.alias("part_no"), "title", "content")


def segmentation_params(runtime, engine, model) -> tuple[Column, Column]:
    """Target and most characters of a chunk for the service that reads it: small for a model in the process."""
    r, e, m = (F.lower(strip(F.coalesce(col(c), F.lit("")))) for c in (runtime, engine, model))
    direct = r == "direct"
    small = direct & ((e == "gguf") | F.endswith(m, F.lit(".gguf")))
    return F.when(small, 4200).when(direct, 5200).otherwise(L.CHUNK_TARGET), F.when(small, 5600).when(direct, 7600).otherwise(L.CHUNK_MOST)


def detection_sample(docs: DataFrame, limit: int = 5000) -> DataFrame:
    """The first non-blank lines until `limit` (600 to 20000) characters, and no more than that."""
    limit = min(max(limit, 600), 20_000)
    lines = F.filter(F.transform(F.split("text", "\n", -1), strip), lambda s: s != "")
    return docs.select("doc_id", F.left(F.array_join(lines, "\n"), F.lit(limit)).alias("sample"))


_UNITS = "array<struct<title:string,content:string,loose:boolean>>"


def _units(parts: Column, loose: bool) -> Column:
    return F.transform(parts, lambda p: F.struct(p["title"].alias("title"), p["content"].alias("content"), F.lit(loose).alias("loose"))).cast(_UNITS)


def _voted(text: Column, override: str | None, guess: Column | None) -> Column:
    """struct<name, by>: the heading pattern and who chose it (own, rules, guess); null without one."""
    counts = F.array(*[F.regexp_count(text, F.lit(p)) for _, p, _ in L.HEADINGS])
    names, weights = F.array(*[F.lit(n) for n, _, _ in L.HEADINGS]), F.array(*[F.lit(w) for _, _, w in L.HEADINGS])

    def chosen(cs):
        votes = F.filter(F.transform(cs, lambda c, i: F.struct((c * F.get(weights, i)).alias("score"), (-i).alias("rank"), c.alias("hits"), F.get(names, i).alias("name"))), lambda v: v["hits"] >= 2)
        best = let(F.array_max(votes), lambda v: F.when(v.isNotNull(), F.struct(v["name"].alias("name"), F.lit("rules").alias("by"))))
        if guess is None:
            return best
        guessed = F.get(cs, F.array_position(names, guess).cast("int") - 1) >= 2
        return F.coalesce(best, F.when(guessed, F.struct(guess.alias("name"), F.lit("guess").alias("by"))))

    voted = let(counts, chosen)
    if not override:
        return voted
    return F.when(F.regexp_count(text, F.lit(override)) >= 1, F.struct(F.lit("custom_regex").alias("name"), F.lit("own").alias("by"))).otherwise(voted)


def structure_of(text: Column, target: int, most: int, override: str | None = None, guess: Column | None = None) -> Column:
    """struct<method, heading_pattern, chosen_by, chapter_count, chunks>; every scan of the text is made once."""
    most = max(most, target)
    regexes = {n: p for n, p, _ in L.HEADINGS} | ({"custom_regex": override} if override else {})
    regex = lambda n: F.try_element_at(F.create_map(*[F.lit(x) for kv in regexes.items() for x in kv]), n)
    none = F.array().cast("array<struct<title:string,content:string>>")

    def divided(vote):
        heads = F.when(vote.isNotNull(), _chapters(text, spans(text, regex(vote["name"])), _unmarked)).otherwise(none)
        whole = F.array(F.struct(F.lit("全文").alias("title"), text.alias("content"), F.lit(True).alias("loose"))).cast(_UNITS)
        rest = let(_scenes(text, F.lit("段落")), lambda ss: F.when(ss.isNotNull(), F.struct(F.lit("scene_break").alias("method"), _units(ss, False).alias("units"))).otherwise(F.struct(F.lit("paragraph").alias("method"), whole.alias("units"))))
        return let(heads, lambda hs: F.when(F.size(hs) > 0, F.struct(F.lit("heading").alias("method"), _units(hs, False).alias("units"))).otherwise(rest))

    def fit(units, headed):
        alone = lambda u: F.array(u).cast(_UNITS)
        scenes = lambda u: F.when(headed & (F.length(u["content"]) > most), _units(_scenes(u["content"], u["title"]), False))
        inner = F.flatten(F.transform(units, lambda u: F.coalesce(scenes(u), alone(u))))
        return F.flatten(F.transform(inner, lambda u: F.when(u["loose"] | (F.length(u["content"]) > most), _units(_packed(u["content"], u["title"], target, most), False)).otherwise(alone(u))))

    def told(vote, d):
        headed = d["method"] == "heading"
        chunks = F.transform(fit(d["units"], headed), lambda u: F.struct(u["title"].alias("title"), u["content"].alias("content")))
        return F.struct(
            d["method"].alias("method"), F.when(headed, vote["name"]).otherwise("none").alias("heading_pattern"), F.coalesce(vote["by"], F.lit("none")).alias("chosen_by"),
            F.coalesce(regex(vote["name"]), F.lit("")).alias("resolved_heading_regex"), F.when(headed, F.size(d["units"])).otherwise(0).alias("chapter_count"), chunks.alias("chunks"),
        )

    return let(_voted(text, override, guess), lambda v: let(divided(v), lambda d: told(v, d)))


def _structured(docs: DataFrame, target: int, most: int, override: str | None, guess: str | None) -> tuple[DataFrame, Column, Column]:
    """Documents with a column _clean, the struct of their structure (null for empty texts), and what preprocessing did.

    Take the struct through a generator: named fields of it would each work it out anew.
    """
    pattern = None if guess is None or guess not in {n for n, _, _ in L.HEADINGS} else F.lit(guess)
    base, clean, info = preprocess_steps(docs, "text")
    found = let(clean, lambda t: F.when(t != "", structure_of(t, target, most, override, pattern)))
    return base, found, info


def detect_structure(docs: DataFrame, target: int = L.CHUNK_TARGET, most: int = L.CHUNK_MOST, override: str | None = None, guess: str | None = None) -> DataFrame:
    """doc_id, method, heading_pattern, chapter_count, chunk_idx, title, content.

    Headings by an own pattern (if it hits), else by vote, else by a guess that hits twice; chapters that are too long are cut
    at scene breaks, and what is still too long between paragraphs. Without headings scene breaks, then paragraphs cut the
    whole text. Preprocessing comes first; an empty text gives nothing. A document is worked off in its row: no shuffle.
    """
    base, found, _ = _structured(docs, target, most, override, guess)
    chunks = let(found, lambda s: F.transform(s["chunks"], lambda c: F.struct(s["method"].alias("method"), s["heading_pattern"].alias("heading_pattern"), s["chapter_count"].alias("chapter_count"), c["title"].alias("title"), c["content"].alias("content"))))
    return base.select("doc_id", F.posexplode(chunks).alias("chunk_idx", "c")).select("doc_id", "c.method", "c.heading_pattern", "c.chapter_count", "chunk_idx", "c.title", "c.content")


def structure_info(docs: DataFrame, target: int = L.CHUNK_TARGET, most: int = L.CHUNK_MOST, override: str | None = None, guess: str | None = None, guess_reason: str = "", sample: int = 5000) -> DataFrame:
    """A row a document: how its structure was found, and what preprocessing did.

    `used_llm_detection` says that neither the own pattern nor the rules found headings, so that a given guess was asked.
    """
    base, found, info = _structured(docs, target, most, override, guess)
    s = base.select("doc_id", F.explode(F.array(F.struct(found.alias("s"), info.alias("info")))).alias("x")).select("doc_id", "x.s", "x.info")
    by = F.coalesce("s.chosen_by", F.lit("none"))
    asked = F.lit(guess is not None) & ~by.isin("own", "rules") & F.col("s").isNotNull()
    resolved = F.when(by == "none", F.lit(override or "")).otherwise(F.col("s.resolved_heading_regex"))
    return s.select(
        "doc_id", F.coalesce("s.method", F.lit("empty")).alias("method"), F.coalesce("s.heading_pattern", F.lit("none")).alias("heading_pattern"),
        F.when(F.col("s").isNull(), "").otherwise(resolved).alias("resolved_heading_regex"), F.coalesce("s.chapter_count", F.lit(0)).alias("chapter_count"),
        F.coalesce(F.size("s.chunks"), F.lit(0)).alias("seed_chunk_count"), asked.alias("used_llm_detection"), F.when(asked, F.lit(guess)).otherwise("none").alias("llm_pattern"),
        F.when(asked, F.lit(guess_reason)).otherwise("").alias("llm_reason"), F.lit(min(max(sample, 600), 20_000)).alias("chapter_sample_chars"),
        F.lit(target).alias("target_chars"), F.lit(max(most, target)).alias("max_chars"), "info.*",
    )
