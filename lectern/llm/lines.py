"""Boilerplate lines: lines that many distinct sites share, found with HyperLogLog sketches merged by aggregation.

Only DataFrame functions. A line is known by two 64-bit hashes of its normalised text (trimmed, white space collapsed,
lower case). One aggregation merges a sketch of the sites of each line; lines whose estimate is near the threshold get an
exact count of distinct sites, the others are decided by their estimate. The first occurrence of a boilerplate line (least
doc_id, then line number) stays, every other goes, so no content is lost from the corpus.

Defined results
* null text stays null; empty lines and lines of fewer than `min_chars` normalised characters always stay;
* a null site (column `source`) counts as no site; a row with a null doc_id stays as it is and its lines are not counted;
* repeated rows: each is cleaned; rows that share a doc_id keep the same line numbers;
* documents that lose all lines stay, with empty text; an empty table gives an empty result;
* other columns, whatever their names, pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
MIN_CHARS = 8
#: Sketches of 2^LG_K registers err by 1.04 / 2^(LG_K / 2), 1.6 % here; estimates within NEAR of the threshold (over six
#: standard errors, and one site at least) are counted exactly.
LG_K, NEAR = 12, 0.1
#: So many line keys (a few MB) may be broadcast; beyond, lines are dealt over SALTS tasks a key and meet by shuffle.
BROADCAST_KEYS, SALTS = 200_000, 16
#: Line numbers to remove that may be broadcast to the documents (some 8 MB); beyond, both are shuffled by document.
BROADCAST_REMOVALS = 1_000_000


def normalised(line):
    return F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))


def document_lines(docs: DataFrame, site: str = "source", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, site, pos, h1, h2 for each line that can be boilerplate; no text goes on."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    norm = rows.select("doc_id", "site", "pos", normalised(F.col("line")).alias("line")).where(F.length("line") >= min_chars)
    return norm.select("doc_id", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2"))


def _with_keys(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """lines joined with keys (h1, h2 once each, written). Few keys are broadcast, behind a count; of many, each is copied for
    SALTS shares of its lines, so a line that a third of all rows hold is many tasks' work."""
    if keys.count() <= BROADCAST_KEYS:
        return lines.join(F.broadcast(keys), ["h1", "h2"])
    copies = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(copies, ["h1", "h2", "salt"]).drop("salt")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, n_sites, first_doc of the lines on at least min_sites distinct sites.

    Only a line that occurs min_sites times can be on so many sites, so lines are counted first and few are sketched. Counts
    and sketches are merged before the shuffle: a line that every task sees is one row a task.
    """
    low, high = min(min_sites - 1, int(min_sites * (1 - NEAR))), max(min_sites + 1, int(min_sites * (1 + NEAR)) + 1)
    often = materialize(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_sites).select("h1", "h2", "first_doc"), "lines-often")
    sketched = _with_keys(lines, often).groupBy("h1", "h2").agg(F.min("first_doc").alias("first_doc"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    wide = materialize(sketched.select("h1", "h2", "first_doc", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= low), "lines-wide")
    near = materialize(wide.where(F.col("estimate") <= high).select("h1", "h2"), "lines-near")
    exact = _with_keys(lines.select("h1", "h2", "site", "doc_id"), near).select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("exact"))
    out = wide.join(exact, ["h1", "h2"], "left").select("h1", "h2", "first_doc", F.coalesce("exact", "estimate").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    out = materialize(out, "lines-boilerplate")
    discard(often, wide, near)
    return out


def removals(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, gone (the numbers, from 0, of the lines to remove); only documents that lose lines."""
    lines = materialize(document_lines(docs, site, min_chars), "lines")
    shared = boilerplate(lines, min_sites)
    found = _with_keys(lines, shared).select("h1", "h2", "doc_id", "pos", "first_doc")
    elsewhere = found.where("doc_id <> first_doc").select("doc_id", "pos")
    at_home = found.where("doc_id = first_doc").groupBy("h1", "h2", "doc_id").agg(F.array_sort(F.collect_set("pos")).alias("all"))
    repeats = at_home.where(F.size("all") > 1).select("doc_id", F.explode(F.slice("all", F.lit(2), F.size("all"))).alias("pos"))
    gone = materialize(elsewhere.unionByName(repeats).groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "lines-gone")
    discard(lines, shared)
    return gone


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _cleaned(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, str]:
    """docs without the lines to remove, and the name of the column that says which went. Few removals are broadcast, behind their count, so texts stay where they are."""
    key, went = _free(docs, "__gone_id"), _free(docs, "__gone")
    keyed = gone.select(F.col("doc_id").alias(key), F.col("gone").alias(went))
    if (gone.agg(F.sum(F.size("gone") + 2)).first()[0] or 0) <= BROADCAST_REMOVALS:
        keyed = F.broadcast(keyed)

    def rest(lines):
        # a set difference of line numbers, so a long text costs no more than its length
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(went))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    kept = F.element_at(F.transform(F.array(F.split("text", "\n")), rest), 1)
    return docs.join(keyed, docs["doc_id"] == keyed[key], "left").withColumn("text", F.when(F.col(went).isNull(), F.col("text")).otherwise(kept)), went


def clean_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with later occurrences of boilerplate lines removed from text; the same columns."""
    return _cleaned(docs, removals(docs, site, min_sites, min_chars))[0].select(*[docs[c] if c != "text" else F.col("text") for c in docs.columns])


def line_report(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, text (cleaned)."""
    gone = removals(docs, site, min_sites, min_chars)
    base = docs.select("doc_id", "text")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    cleaned, went = _cleaned(base.withColumn("__lines", n_lines), gone)
    return cleaned.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.coalesce(F.size(went), F.lit(0)).cast("long").alias("n_removed"), "text")


ORACLE = f"""
with lines as (
  select doc_id, source, pos - 1 as pos, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) as line
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
        from documents where doc_id is not null and text is not null)
), ok as (select * from lines where length(line) >= {MIN_CHARS}),
shared as (select line, min((doc_id, pos)) as first from ok group by line having count(distinct source) >= {MIN_SITES}),
gone as (select doc_id, list(distinct pos) as gone from ok join shared using (line) where (doc_id, pos) <> first group by doc_id)
select d.doc_id,
  case when text is null then 0 else len(string_split(text, chr(10))) end::bigint as n_lines,
  coalesce(len(gone), 0)::bigint as n_removed,
  case when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: not list_contains(gone, i - 1)), chr(10)) end as text
from documents d left join gone g using (doc_id)
"""
