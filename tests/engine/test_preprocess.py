"""Preprocessing against plain Python: entities, then all rules of the built-in profile."""

import html
import re

from lectern.functions import lexicon as L
from lectern.functions import text as T
from lectern.operators import splitting
from lectern.plans import adapters as A
from lectern.plans.catalogue import QUERIES

#: The rules of the profile in their order, as Python reads them.
RULES = [
    ("phrase_fangfo_01", "彷佛", "仿佛"), ("phrase_fangfo_02", "彷彿", "仿佛"), ("phrase_fangfo_03", "仿彿", "仿佛"), ("char_tiao_after_entity_decode", "䠷", "挑"), ("phrase_liaojie", "瞭解", "了解"), ("char_jie", "姊", "姐"), ("phrase_fanfu", "反覆", "反复"),
    ("char_black", "黒", "黑"), ("char_drink", "飮", "饮"), ("char_lai", "瀬", "濑"), ("char_dan", "弾", "弹"), ("char_jian", "剣", "剑"), ("char_chuan", "伝", "传"), ("char_bu", "歩", "步"), ("char_jia", "仮", "假"), ("char_quan", "圏", "圈"), ("pronoun_ni", "妳", "你"), ("pronoun_ta", "牠", "它"),
    ("decorative_separator", r"(?:✽\s*){3,}", "***"),
]
TEXTS = ["黒飮瀬弾剣伝歩仮圏妳牠 祂", "&#x4837;&#31066;祂 &amp;amp; &eacute; A&ampB &#0; a & b", "甲\n✽✽✽\n乙 ✽ ✽　✽\n\n✽", "✽✽ 二", "", None, "✽ " * 50_000, "彷彿瞭解&lt;姊&gt;&nbsp;反覆"]


def plain(text):
    x, hits = html.unescape((text or "").replace("祂", "PRESERVE_0")), {}
    for rule, source, target in RULES:
        x, hits[rule] = re.subn(source, target, x)
    return x.replace("PRESERVE_0", "祂").replace("\r\n", "\n").strip(), hits


def test_profile_has_every_rule_in_order():
    assert [(r[0], r[3]) for r in L.DEFAULT_RULES] == [(r, t) for r, _, t in RULES]


def test_preprocess_equals_python(spark):
    out, hits = T.preprocess("text")
    got = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select("doc_id", out.alias("o"), *[h.alias(r) for r, h in hits.items()]).orderBy("doc_id").collect()
    for r, text in zip(got, TEXTS):
        assert (r.o, {k: r[k] for k in hits}) == plain(text)


def test_rule_hits_reports_every_rule(spark, sf):
    got = {r.rule: r.hits for r in QUERIES["rule_hits"](spark, sf).collect()}
    found = [plain(r.text)[1] for r in A.prose(spark, sf).select("text").collect()]
    assert got == {rule: sum(h[rule] for h in found) for rule, _, _ in RULES}


def test_structure_sees_entities_and_separators(spark):
    texts = ["甲文。\n&#42;&#42;&#42;\n乙文。", "第一章 一\n甲\n第二章 二\n乙\n✽ ✽ ✽"]
    got = splitting.detect_structure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "chunk_idx").collect()
    assert [(r.method, r.content) for r in got] == [("scene_break", "甲文。"), ("scene_break", "乙文。"), ("heading", "甲"), ("heading", "乙\n***")]


def test_white_space_is_what_python_strips(spark):
    assert set(L.WHITE_SPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}
    texts = ["", " ", L.WHITE_SPACE, None, "\u3000甲 乙\u2009\x1f", "\x85a\n\nb\xa0", "\u200b甲\u200b", "甲" + " " * 100_000 + "乙 "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(T.strip("t").alias("s"), T.lstrip("t").alias("l"), "t").collect()
    assert all(r.t is None and r.s is None or (r.s, r.l) == (r.t.strip(), r.t.lstrip()) for r in rows)
