"""Re-splitting over recorded calls against a plain recursion, and what awkward logs lead to."""

import random

import pytest

from lectern.operators import resplit

ERRORS = {"timeout": "Read timed out", "filter": "content_filter hit", "length": "finish_reason=length", "transient": "503"}
REASON = {"filter": "content_filter", "length": "finish_reason_length", "decode": "compact_decode_failed", "timeout": "compact_decode_failed"}


def cut(sizes, first, last, chars, count):
    out, size = [], 0
    for n in range(first, last + 1):
        if not out or len(out[-1]) >= count or size + sizes[n - 1] > chars:
            out.append([])
            size = 0
        out[-1].append(n)
        size += sizes[n - 1]
    return [(p[0], p[-1]) for p in out]


def plain(sizes, shown, verdict, budget, most_lines, title="t"):
    """(first, last, title, reason) of settled ranges and (event, title, parts)."""
    done, events = [], []

    def ask(first, last, name):
        kind = verdict(first, last)
        if kind is None:
            return done.append((first, last, name, None))
        kind = "decode" if kind == "transient" else kind
        parts = cut(sizes, first, last, *resplit.limits(kind, budget, most_lines))
        if kind == "timeout" and len(parts) < 2:
            kind = "decode"
            parts = cut(sizes, first, last, *resplit.limits(kind, budget, most_lines))
        label = "content_filter" if kind == "filter" else kind
        if len(parts) < 2:
            done.append((first, last, name, REASON[kind]))
            return events.append((label + "_skip", name, 0))
        events.append((label + "_split", name, len(parts)))
        for k, (a, b) in enumerate(parts, 1):
            ask(a, b, f"{name}（第{k}部分）")

    begin = cut(sizes, 1, len(sizes), budget, most_lines)
    if (len(sizes) > most_lines or shown > 2 * budget) and len(begin) > 1:
        for k, (a, b) in enumerate(begin, 1):
            ask(a, b, f"{title}（第{k}部分）")
    else:
        ask(1, len(sizes), title)
    return done, events


@pytest.mark.parametrize("budget, most_lines", [(1200, 48), (900, 20)])
def test_ranges_are_those_of_a_plain_recursion(spark, budget, most_lines):
    rng, lines, calls, want = random.Random(budget), [], [], {}
    for doc in range(25):
        texts = ["x" * rng.choice([1, 5, 40, 90, 400, 1500]) for _ in range(rng.randrange(1, 70))]
        lines += [(doc, 0, i, f"L{i}", t, "t") for i, t in enumerate(texts, 1)]
        n, log = len(texts), {}

        def verdict(first, last):
            wide = last - first + 1
            odds = min(0.9, wide / 12) if wide > 1 else 0.25
            return log.setdefault((first, last), rng.choice(["timeout", "filter", "length", "transient", "decode"]) if rng.random() < odds else None)

        shown = sum(len(f"L{i}") + 3 + len(t) for i, t in enumerate(texts, 1)) - 1
        want[doc] = plain([len(t) for t in texts], shown, verdict, budget, most_lines)
        for (a, b), kind in log.items():
            calls.append((doc, 0, a, b, "SEGS:\nL1-L%d 0 ne h" % (b - a + 1) if kind is None else "?" if kind == "decode" else None, ERRORS.get(kind)))
    made = spark.createDataFrame(lines, "doc_id long, chunk_idx int, line_no int, line_id string, text string, title string")
    log = spark.createDataFrame(calls, "doc_id long, chunk_idx int, first int, last int, response string, error string")
    for r in resplit.settled_pieces(made, resplit.outcomes(log), budget, most_lines).collect():
        done, events = want[r.doc_id]
        assert [(p.first, p.last, p.title, p.reason) for p in r.pieces] == done and all(p.settled for p in r.pieces)
        assert sorted((e.event, e.title, e.parts) for e in r.events) == sorted(events)
    rows = resplit.analyse_recorded(made, log, budget, most_lines).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.line_id, r.text) for r in rows] == [(d, i, t) for d, _, _, i, t, _ in lines]
    assert {r.skip_reason for r in rows} == {None, *REASON.values()} and all(r.needs_review == (r.skip_reason is not None) for r in rows)
    given_up = next(r for r in rows if r.skip_reason == "content_filter")
    assert given_up.evidence == f"{given_up.source_title} {given_up.line_id} 触发 content_filter，已保留原文并跳过 LLM 角色归属。content_filter hit" and given_up.speaker == "UNKNOWN"


def test_awkward_logs(spark):
    lines = spark.createDataFrame([(1, 0, 1, "L1", "甲"), (1, 0, 2, "L2", "乙"), (2, 0, 1, "L1", "丙")], "doc_id long, chunk_idx int, line_no int, line_id string, text string")
    kind = "doc_id long, chunk_idx int, first int, last int, response string, error string"
    none = resplit.analyse_recorded(lines, spark.createDataFrame([], kind)).collect()
    assert len(none) == 3 and {r.skip_reason for r in none} == {"compact_decode_failed"} and none[0].evidence.endswith("no reply")
    twice = spark.createDataFrame([(1, 0, 1, 2, None, "503"), (1, 0, 1, 2, "L1-L2 0 ne", None), (2, 0, 1, 1, "L9 0 ne h", None), (9, 0, 1, 1, "L1 0 ne", None)], kind)
    got = {(r.doc_id, r.line_id): (r.speaker, r.skip_reason) for r in resplit.analyse_recorded(lines, twice).collect()}
    assert got == {(1, "L1"): ("旁白", None), (1, "L2"): ("旁白", None), (2, "L1"): ("UNKNOWN", "compact_decode_failed")}
    assert resplit.analyse_recorded(lines.limit(0), twice).count() == 0


def test_a_chunk_and_its_calls_are_read_once(spark):
    """Pieces, replies and given-up lines each read the chunks and the calls anew: 12 scans of a table in the end."""
    lines = spark.createDataFrame([(1, 0, i, f"L{i}", "x" * (i % 7 + 1), "t") for i in range(1, 1501)], "doc_id long, chunk_idx int, line_no int, line_id string, text string, title string")
    calls = [(1, 0, a, b, f"SEGS:\nL1-L{b - a + 1} 0 ne h" if b - a < 5 and a % 10 != 1 else None, "content_filter" if a % 10 == 1 else "finish_reason=length") for a in range(1, 1501) for b in range(a, min(a + 10, 1501))]
    log = spark.createDataFrame([(*c[:5], None if c[4] else c[5]) for c in calls], "doc_id long, chunk_idx int, first int, last int, response string, error string")
    done = resplit.analyse_recorded(lines, log, 1200, 48)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("ArrowEvalPython") == 1
    events = resplit.resplit_events(lines, log, 1200, 48)
    assert events._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    verdict = {(c[2], c[3]): None if c[4] else "filter" if "filter" in c[5] else "length" for c in calls}
    sizes = [i % 7 + 1 for i in range(1, 1501)]
    shown = sum(len(f"L{i}") + 3 + n for i, n in enumerate(sizes, 1)) - 1
    settled, told = plain(sizes, shown, lambda a, b: verdict.get((a, b), "decode"), 1200, 48)
    want = {i: r for a, b, _, r in settled for i in range(a, b + 1)}
    rows = done.orderBy("seq").collect()
    assert [(r.seq, r.line_id, r.skip_reason) for r in rows] == [(i, f"L{i}", want[i]) for i in range(1, 1501)]
    assert sorted((r.event, r.title, r.parts) for r in events.collect()) == sorted(told)
