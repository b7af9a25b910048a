"""Sequential attribution: the fold in the JVM against the one that asks a service, its plan, and long documents."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import lexicon as L
from lectern.operators import attribution
from lectern.plans.novel import parse_novel

NAMES = ["陆沉", "苏晚", "顾长风", "林小满"]


def quotes(spark, rng, documents, most, hinted):
    """Random quotes: cues, pronouns, observers, group names, and stretches without any name."""
    near = NAMES + ["长风", "路人", "众人", "公子"]
    rows = []
    for d in range(documents):
        for q in range(1, rng.randrange(1, most) + 1):
            a, b = rng.choice(near), rng.choice(near)
            before = rng.choice(["", "风很大。", f"{a}说道：", f"{a}看见{b}，{rng.choice(near)}走进。", f"{a}望向{b}", "他笑道：", "她问：", f"{a}对{b}说：", "众人齐声道：", f"{a}推门。{b}坐下"])
            after = rng.choice(["", "", f"{b}问道。", "夜深了", f"{a}、{b}、{a}"])
            text = rng.choice(["好", "我走", "我是" + a, "你来", a])
            rows.append((d, q, f"q{q:04d}", text, before, after))
    df = spark.createDataFrame(rows, "doc_id long, quote_no int, quote_id string, text string, context_before string, context_after string")
    aliases = F.create_map(*[F.lit(x) for n in NAMES for x in (n, n)], F.lit("长风"), F.lit("顾长风")) if hinted else F.create_map().cast("map<string,string>")
    hints = F.array(*[F.lit(n) for n in NAMES]) if hinted else F.array().cast("array<string>")
    return df.withColumns({"aliases": aliases, "hints": hints, "narrator": F.lit("陆沉" if hinted else None).cast("string")})


@pytest.mark.parametrize("hinted", [True, False])
def test_both_folds_decide_alike(spark, hinted):
    some = quotes(spark, random.Random(4 + hinted), 40, 30, hinted)
    got = attribution.classic(some)
    want = attribution._classic_live(attribution._observed(some), None, L.MAX_CANDIDATES)
    assert got.columns == want.columns
    a, b = (sorted(map(repr, df.collect())) for df in (got, want))
    assert len(a) > 300 and a == b
    kinds = {r.evidence for r in got.collect()}
    assert {"观察者动作启发式", "首轮候选排序启发式", "观察目标轮替启发式", "连续双人对话轮替启发式"} <= kinds


def test_small_steps_and_carried_columns(spark, monkeypatch):
    monkeypatch.setattr("lectern.functions.folds.FOLDED", 4)
    some = quotes(spark, random.Random(9), 5, 30, True)
    got = attribution.classic(some, carry=("quote_no", "quote_id", "text", "context_before"))
    assert got.columns[-3:] == ["quote_id", "text", "context_before"]
    want = attribution._classic_live(attribution._observed(some), None, L.MAX_CANDIDATES).join(some.select("doc_id", "quote_no", "quote_id", "text", "context_before"), ["doc_id", "quote_no"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_no_python_worker_and_one_exchange(spark):
    plan = attribution.classic(quotes(spark, random.Random(1), 3, 5, True))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_empty_and_long_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert parse_novel(none, NAMES).count() == 0
    book = "\n".join(f"{NAMES[i % 3]}说道：「第{i}句」\n「嗯{i}」" for i in range(3000))
    got = parse_novel(spark.createDataFrame([(1, book), (2, ""), (3, None)], "doc_id long, text string"), NAMES).select("doc_id", "seq", "speaker").collect()
    assert len(got) == 6000 and {r.doc_id for r in got} == {1}
    assert [r.speaker for r in sorted(got, key=lambda r: r.seq)][:6:2] == ["陆沉", "苏晚", "顾长风"]
