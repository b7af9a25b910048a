"""Steps that were too slow or held too much on large tables: same results, in the row and without shuffles."""

import html
import random
import re
import time

from pyspark.sql import functions as F

from lectern.functions import lexicon as L
from lectern.functions import text as T
from lectern.functions.lines import lines_of, parts_of
from lectern.operators import quotes, splitting
from lectern.plans.novel import optimise_chunks, plan_and_optimise, plan_chunks, presplit
from lectern.sources.html import html_unescape_closed


def one_column(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_unclosed_references_stay(spark):
    got = [r.t for r in one_column(spark, "a&&amp</title>&amp;lt; &eacute;&#x4e2d;&#20013; &notit; &quo", None).orderBy("doc_id").select(html_unescape_closed("text").alias("t")).collect()]
    assert got == ["a&&amp</title>&lt; é中中 &notit; &quo", None]
    named = "&lt;a&gt;&copy;&middot;&nbsp;&quot;&#39;&amp;"
    assert one_column(spark, named).select(html_unescape_closed("text").alias("t")).first().t == html.unescape(named)


def chunked(spark, *texts):
    rows = [(i, 0, "t", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, chunk_idx int, title string, content string")


def test_lines_and_parts_are_read_on(spark):
    text = " 甲 \n\u3000\n" + "一二。三四！」五\n" + "x" * 9
    assert lines_of(text, 4) == [(1, "甲"), (6, "一二。三四！」"), (13, "五"), (15, "x" * 9)]
    assert parts_of([3, 3, 9, 1, 1, 1], 6, 2) == [0, 0, 1, 2, 2, 3]
    got = [(r.line_no, r.start, r.end, r.text) for r in splitting.number_lines(chunked(spark, text, None, "", " \n "), 4).orderBy("doc_id", "line_no").collect()]
    assert got == [(i + 1, s, s + len(t), t) for i, (s, t) in enumerate(lines_of(text, 4))]


def test_slices_are_cut_in_the_row(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab。！」\n \u3000") for _ in range(rng.randrange(900))) for _ in range(40)]
    chunks = chunked(spark, *texts, None, "", " \n ")
    sliced = splitting.line_slices(chunks, 60, 5)
    assert exchanges(sliced) == 0
    lines = splitting.number_lines(chunks.select("doc_id", "chunk_idx", "content"))
    budget = {(r.doc_id, r.line_no): r.part for r in splitting.line_budget(lines, 60, 5).collect()}
    by_part = {}
    for r in lines.orderBy("doc_id", "line_no").collect():
        by_part.setdefault((r.doc_id, budget[r.doc_id, r.line_no]), []).append(r)
    want = {k: (f"t（第{k[1] + 1}部分）", texts[k[0]][v[0].start : v[-1].end].strip(), [r.line_id for r in v], "\n".join(f"{r.line_id}: {r.text}" for r in v)) for k, v in by_part.items()}
    assert {(r.doc_id, r.part): (r.title, r.content, r.line_ids, r.numbered_text) for r in sliced.collect()} == want


def test_long_chunks_are_sliced_in_the_row(spark):
    chunks = chunked(spark, "甲\n乙\n丙", "甲\n乙", "甲" * 9 + "\n乙", None, "", " \n")
    cut = presplit(chunks, 14, 3)
    assert exchanges(cut) == 0
    got = sorted((r.doc_id, r.part, r.title, r.content) for r in cut.where("content is not null").collect())
    assert got == [(0, 0, "t（第1部分）", "甲\n乙\n丙"), (1, 0, "t", "甲\n乙"), (2, 0, "t（第1部分）", "甲" * 9 + "\n乙"), (4, 0, "t", ""), (5, 0, "t", " \n")]
    assert cut.where("content is null").count() == 1


def test_lines_of_a_long_text_take_little_time(spark):
    text = "\n".join("word " * 60 + "." for _ in range(4000)) + "\n" + "一句话。" * 20_000
    chunks = chunked(spark, *[text] * 8)
    splitting.number_lines(chunks).count()
    begun = time.monotonic()
    assert splitting.number_lines(chunks).where("length(text) > 0").count() == 8 * (4000 + 500)
    assert time.monotonic() - begun < 8


def test_line_ends_get_marks_quickly(spark):
    plainly = lambda t: re.sub("([^\n。！？!?；;：:])\n([^\n])", r"\1。\n\2", re.sub("\n{3,}", "\n\n", t)).strip()
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n\n。:𝄞") for _ in range(rng.randrange(30))) for _ in range(3000)]
    got = one_column(spark, *texts).select("doc_id", T.tts_cleanup("text").alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in got] == [plainly(t) for t in texts]
    long_ = spark.range(8).select(F.repeat(F.lit("some words of prose "), 200_000).alias("text"))
    begun = time.monotonic()
    assert long_.select(T.tts_cleanup("text").alias("t")).where("length(t) > 0").count() == 8
    assert time.monotonic() - begun < 8


def test_colon_quotes_are_the_same_with_a_look_ahead(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("甲乙说道问：:a_ 。\n「") for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["甲" * n + "说：走。" for n in range(30)] + ["甲" * n + "心想：走。" for n in range(30)]
    every = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    rows = one_column(spark, *texts).select(every(L.COLON_QUOTE).alias("a"), every(quotes._COLON_QUOTE).alias("b"))
    assert rows.where("a <> b").count() == 0 and rows.where("size(a) > 0").count() > 50


def replies(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in texts], "doc_id long, chunk_idx int, response string")


def test_plans_and_rewrites_meet_their_chunk_once(spark):
    """Every step that read the chunks anew read them again for each step before it: 186 scans of a table in the end."""
    chunks = chunked(spark, "一。\n\n 二【x】\n三", "甲\n乙", " \n", "丙\n丁", "戊")
    plans = replies(spark, (0, "CHUNKS:\nL1 | 头\nL2-L3 |"), (1, "L1 | x"), (2, "L1 | x"), (3, "L1-L2 | y"), (3, "L1-L2 | y"), (9, "L1 | z"))
    got = [(r.doc_id, r.part_no, r.title, r.content) for r in plan_chunks(chunks, plans).orderBy("doc_id", "part_no").collect()]
    assert got == [(0, 1, "头", "一。"), (0, 2, "第2块", "二【x】\n三"), (1, 1, "t", "甲\n乙"), (2, 1, "t", " \n"), (3, 1, "t", "丙\n丁"), (4, 1, "t", "戊")]
    told = replies(spark, (0, "OPT:\nL1 ~ 壹\nL2-L3 ="), (1, "L1 =\nL1-L2 ="), (3, "L1 ~ 叁\nL2-L2 ="), (4, "L1-L999999999 ="))
    assert [r.content for r in optimise_chunks(chunks, told).orderBy("doc_id").collect()] == ["壹\n\n 二【x】\n三", "甲。\n乙", "", "叁\n丁", "戊"]
    both = plan_and_optimise(chunks, plans, told)
    assert [(r.doc_id, r.chunk_idx, r.title) for r in both.orderBy("doc_id", "chunk_idx").collect()] == [(0, 0, "头"), (0, 1, "第2块"), (1, 0, "t"), (2, 0, "t"), (3, 0, "t"), (4, 0, "t")]
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 3 and plan.count("Exchange") <= 8
