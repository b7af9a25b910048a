"""Prose, books, segments and clips built from the given tables, in Spark and, for the checks, as DuckDB text.

The tables hold no Chinese prose, so each adapter words rows of a whole table as novel text with names, cues and quotes. Both
dialects spell the same recipe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import lexicon as L
from ..functions.text import strings

NAMES = ["陆沉", "苏晚", "顾长风", "林小满"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(strings(values), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


#: A line that holds a source of most rules of the built-in profile, and a separator.
RULED = "牠歩出仮山，黒夜弾剣伝瀬圏，妳彷彿反覆瞭解彷佛，姊姊飮茶。✽ ✽✽"


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, turn, heading, line: each whole turn as narration or as a quote with one of ten kinds of cue. Every fourth turn
    opens a chapter; a third of the documents' chapters are told as somebody's story."""
    c = _table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    rows = c.select(
        F.col("conv_id").alias("doc_id"), "turn", "role", F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\r]+", " ").alias("t"),
        _pick(NAMES, F.col("conv_id")).alias("n1"), _pick(NAMES, F.col("conv_id") + 1).alias("n2"), F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(10)).alias("k"),
    )
    line = (
        F.when(F.col("role") == "system", F.col("t"))
        .when(F.col("k") == 0, F.concat("n1", F.lit("说道：「"), "t", F.lit("」")))
        .when(F.col("k") == 1, F.concat(F.lit("「"), "t", F.lit("」"), "n1", F.lit("问道。")))
        .when(F.col("k") == 2, F.concat("n1", F.lit("对"), "n2", F.lit("说：“"), "t", F.lit("”")))
        .when(F.col("k") == 3, F.concat(F.lit("「"), "t", F.lit("」")))
        .when(F.col("k") == 4, F.concat(F.lit("「我"), "t", F.lit("」  那个")))
        .when(F.col("k") == 5, F.concat(F.lit("众人齐声道：「"), "t", F.lit("」")))
        .when(F.col("k") == 6, F.concat("n2", F.lit("看见"), "n1", F.lit("，推门走进。『我是"), "n2", F.lit("』"), "t"))
        .when(F.col("k") == 7, F.concat("n1", F.lit("心想："), "t", F.lit("。")))
        .when(F.col("k") == 8, F.concat(F.lit("他笑道：「"), "t", F.lit("」")))
        .otherwise(F.concat("t", F.lit(RULED)))
    )
    number = (F.col("turn") / 4).cast("int").cast("string")
    story = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat("n2", F.lit("的故事"))).otherwise(F.lit("归途"))
    heading = F.when(F.pmod("turn", F.lit(4)) == 0, F.concat(F.lit("第"), number, F.lit("章 "), story))
    return rows.select("doc_id", "turn", heading.alias("heading"), line.alias("line"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a document a conversation."""
    headed = F.concat_ws("\n", "heading", "line").alias("line")
    lines = conversation_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("turn", headed))).alias("ls"))
    return lines.select("doc_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("text"))


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: documents as books with preamble, chapters, scene breaks and blank lines."""
    d = _table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    kind = F.pmod("doc_id", F.lit(4))
    spaced = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    text = (
        F.when(kind == 0, F.concat(F.lit("序\n\n第一章 "), "source", F.lit("\n\n"), spaced, F.lit("\n\n第二章 "), "lang", F.lit("\n"), F.col("text"), F.lit("\n第三章\n")))
        .when(kind == 1, F.concat(spaced, F.lit("\n***\n"), F.col("text"), F.lit("\n\n ---- \n"), F.col("source")))
        .when(kind == 2, F.concat(F.lit("Chapter 1 x\n"), F.col("text"), F.lit("\nChapter 2\n"), spaced))
        .otherwise(F.concat(F.lit("【"), F.col("source"), F.lit("】（"), F.col("lang"), F.lit("）[x]\n\n\n\n"), spaced))
    )
    return d.select("doc_id", text.alias("text"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq and the segment columns, a row a turn."""
    c = _table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    c = c.withColumn("seq", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    i, s = F.col("conv_id"), F.col("seq")
    speaker = F.when(F.col("role") == "system", "旁白").when(F.pmod(i * 3 + s, F.lit(11)) == 0, "UNKNOWN").when(F.pmod(i + s, F.lit(13)) == 0, "未知").otherwise(_pick(["陆沉", "苏晚", "陆沉", "苏晚", "苏菲亚", "罗兰"], i + F.floor(s / 3)))
    confidence = F.element_at(F.array(*[F.lit(x) for x in (0.2, 0.42, 0.58, 0.62, 0.7, 0.82, 0.96)]), (F.pmod(i * 7 + s * 3, F.lit(7)) + 1).cast("int"))
    scene = F.element_at(F.array(strings([]), strings(["陆沉", "苏晚"]), strings(["陆沉"]), strings(["陆沉", "苏晚", "苏菲亚"])), (F.pmod(i + s, F.lit(4)) + 1).cast("int"))
    before = F.when(F.pmod(i + s, F.lit(5)) == 0, "他对着陆沉说道：").when(F.pmod(i + s, F.lit(5)) == 1, "望着苏晚，又说").otherwise(F.left(F.coalesce("text", F.lit("")), F.lit(40)))
    return c.select(
        i.alias("doc_id"), "seq", F.format_string("q%04d", s).alias("quote_id"), speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"), confidence.alias("confidence"),
        F.when(F.pmod(s, F.lit(2)) == 0, "线索").otherwise("").alias("evidence"), _pick(["implicit", "unknown", "explicit_before"], s).alias("attribution_type"), scene.alias("scene_characters"), before.alias("context_before"),
        _pick(["neutral", "Cold", " angry ", "wild"], i + s).alias("emotion"), _pick(["male, whisper", "FEMALE , elderly", "", "loud, male,male, low pitch", "child"], i * 3 + s).alias("style"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """out, idx, frames, sample_rate, channels, duration, speaker, text: a clip a line item, an output an order."""
    item = _table(spark, sf_dir, "lineitem").where("l_orderkey is not null and l_linenumber is not null")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return item.select(
        F.col("l_orderkey").alias("out"), place.cast("long").alias("idx"), (F.col("l_quantity") * 8000).cast("long").alias("frames"), F.lit(16000).alias("sample_rate"), F.lit(1).alias("channels"),
        (F.col("l_quantity") * 0.5).alias("duration"), F.when(F.col("l_linenumber") % 3 == 0, "旁白").otherwise(F.col("l_linestatus")).alias("speaker"), F.when(F.col("l_linenumber") % 4 == 0, " ").otherwise(F.col("l_returnflag")).alias("text"),
    )


# ---- the same recipes as DuckDB text: common table expressions ----

_N = "['陆沉','苏晚','顾长风','林小满']"
STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
NORMALISE = lambda x: STRIP(f"regexp_replace(regexp_replace(replace(replace(translate(replace(coalesce({x}, ''), chr(65279), ''), '“”『』《》', '「」「」「」'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")

SQL_PROSE = f"""
conv as (
  select conv_id, turn, role, regexp_replace(coalesce(text, ''), '[\\n\\r]+', ' ', 'g') as t,
    {_N}[(conv_id % 4) + 1] as n1, {_N}[((conv_id + 1) % 4) + 1] as n2, (conv_id * 7 + turn * 3) % 10 as k
  from conversations where conv_id is not null and turn is not null
), prose_lines as (
  select conv_id as doc_id, turn,
    case when turn % 4 = 0 then '第' || (turn // 4) || '章 ' || case when conv_id % 3 = 0 then n2 || '的故事' else '归途' end end as heading,
    case when role = 'system' then t when k = 0 then n1 || '说道：「' || t || '」' when k = 1 then '「' || t || '」' || n1 || '问道。'
    when k = 2 then n1 || '对' || n2 || '说：“' || t || '”' when k = 3 then '「' || t || '」' when k = 4 then '「我' || t || '」  那个'
    when k = 5 then '众人齐声道：「' || t || '」' when k = 6 then n2 || '看见' || n1 || '，推门走进。『我是' || n2 || '』' || t
    when k = 7 then n1 || '心想：' || t || '。' when k = 8 then '他笑道：「' || t || '」' else t || '{RULED}' end as line
  from conv
), docs as (
  select doc_id, string_agg(line, chr(10) order by turn, line) as text
  from (select doc_id, turn, concat_ws(chr(10), heading, line) as line from prose_lines) group by doc_id
), norm as (select doc_id, {NORMALISE('text')} as text from docs)"""

_BRACKET, _COLON = L.BRACKET_QUOTE, L.COLON_QUOTE


def sql_spans(name: str, source: str, pattern: str) -> str:
    """{name}(doc_id, text, pos, raw, s, e): matches of pattern with offsets."""
    return f"""
{name}_a as (select doc_id, text, regexp_extract_all(text, '{pattern}') as m, regexp_split_to_array(text, '{pattern}') as g from {source}),
{name}_b as (select doc_id, text, unnest(m) as raw, unnest(g[1:len(m)]) as gap, generate_subscripts(m, 1) as pos from {name}_a),
{name}_c as (select doc_id, text, pos, raw, (sum(len(gap) + len(raw)) over (partition by doc_id order by pos))::int as e from {name}_b),
{name} as (select doc_id, text, pos, raw, (e - len(raw))::int as s, e from {name}_c)"""


SQL_QUOTES = (
    SQL_PROSE + "," + sql_spans("br", "norm", _BRACKET) + "," + sql_spans("co", "norm", _COLON) + f"""
, br2 as (select *, regexp_replace(substr(text, e + 1, 4), '^\\s+', '') as nx from br),
br3 as (select * from br2 where not (starts_with(nx, '这个') or starts_with(nx, '那个') or starts_with(nx, '一声') or starts_with(nx, '了一声')
  or (starts_with(nx, '的') and (substr(nx, 2, 1) = '' or not contains('话是都有吗呢啊嘛了吧哦哟', substr(nx, 2, 1)))))),
co2 as (select co.*, e - len(regexp_extract(raw, '[：:](.*)', 1)) as qs, regexp_extract(raw, '[：:](.*)', 1) as q from co where not exists (select 1 from br3 where br3.doc_id = co.doc_id and br3.s <= co.s and co.s < br3.e)),
allq as (select doc_id, text as body, s as raw_start, e as raw_end, s as start, e as "end", {STRIP("substr(raw, 2, len(raw) - 2)")} as text, raw from br3
  union all select doc_id, text, s, e, qs::int, e, {STRIP('q')}, raw from co2),
quotes as (select doc_id, (row_number() over (partition by doc_id order by raw_start, raw_end))::int as quote_no, text, start::int as start, "end"::int as "end", raw_start::int as raw_start, raw_end::int as raw_end,
  {STRIP('substr(body, greatest(0, start - 120)::int + 1, (start - greatest(0, start - 120))::int)')} as context_before, {STRIP('substr(body, "end" + 1, 120)')} as context_after, raw, body from allq),
q as (select *, 'q' || lpad(quote_no::varchar, greatest(4, len(quote_no::varchar))::int, '0') as quote_id from quotes)"""
)

SQL_SEGMENTS = """
c0 as (select *, (row_number() over (partition by conv_id order by turn, text))::int as seq from conversations where conv_id is not null and turn is not null),
seg as (
  select conv_id as doc_id, seq, 'q' || lpad(seq::varchar, greatest(4, len(seq::varchar))::int, '0') as quote_id,
    case when role = 'system' then '旁白' when (conv_id * 3 + seq) % 11 = 0 then 'UNKNOWN' when (conv_id + seq) % 13 = 0 then '未知' else ['陆沉','苏晚','陆沉','苏晚','苏菲亚','罗兰'][((conv_id + seq // 3) % 6) + 1] end as speaker,
    coalesce(text, '') as text, [0.2::double, 0.42::double, 0.58::double, 0.62::double, 0.7::double, 0.82::double, 0.96::double][((conv_id * 7 + seq * 3) % 7) + 1] as confidence,
    case when seq % 2 = 0 then '线索' else '' end as evidence, ['implicit','unknown','explicit_before'][(seq % 3) + 1] as attribution_type,
    case (conv_id + seq) % 4 when 0 then []::varchar[] when 1 then ['陆沉','苏晚'] when 2 then ['陆沉'] else ['陆沉','苏晚','苏菲亚'] end as scene_characters,
    case (conv_id + seq) % 5 when 0 then '他对着陆沉说道：' when 1 then '望着苏晚，又说' else left(coalesce(text, ''), 40) end as context_before,
    ['neutral','Cold',' angry ','wild'][((conv_id + seq) % 4) + 1] as emotion, ['male, whisper','FEMALE , elderly','','loud, male,male, low pitch','child'][((conv_id * 3 + seq) % 5) + 1] as style
  from c0
)"""

SQL_BOOKS = """
books as (select doc_id, case doc_id % 4
  when 0 then '序' || chr(10) || chr(10) || '第一章 ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '第二章 ' || lang || chr(10) || text || chr(10) || '第三章' || chr(10)
  when 1 then replace(text, chr(10), chr(10) || chr(10)) || chr(10) || '***' || chr(10) || text || chr(10) || chr(10) || ' ---- ' || chr(10) || source
  when 2 then 'Chapter 1 x' || chr(10) || text || chr(10) || 'Chapter 2' || chr(10) || replace(text, chr(10), chr(10) || chr(10))
  else '【' || source || '】（' || lang || '）[x]' || chr(10) || chr(10) || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) end as text
  from documents where doc_id is not null and text is not null)"""

SQL_CLIPS = """
clips as (select l_orderkey as "out", row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as idx, (l_quantity * 8000)::bigint as frames, 16000 as sample_rate, 1 as channels, l_quantity * 0.5::double as duration,
  case when l_linenumber % 3 = 0 then '旁白' else l_linestatus end as speaker, case when l_linenumber % 4 = 0 then ' ' else l_returnflag end as text
  from lineitem where l_orderkey is not null and l_linenumber is not null)"""
