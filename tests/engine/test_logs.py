"""Attempt logs, progress feeds, previous speakers and chapters against plain loops."""

import random
import re
import time

from pyspark.sql import functions as F

from lectern.functions import lexicon as L
from lectern.operators import calls, codecs, quotes, service

ERRORS = ["timed out", "HTTP 503", "finish_reason=length 500", "bad json", "content_filter"]


def plain_call(log, profiles, plain):
    """(outcome, attempts, waited) of the retry loop over recorded attempts."""
    waited, made = 0, 0
    for p in range(1, (1 if plain else profiles) + 1):
        for a in range(1, 4):
            if (p, a) not in log:
                return "open", made, waited
            if made:
                waited += pause
            made += 1
            error = log[p, a]
            if error is None:
                return "ok", made, waited
            if plain and ("length" in error or not any(x in error for x in ("timed out", "503"))):
                return "stopped", made, waited
            pause = 1200 * a if a < 3 else 1200
    return "exhausted", made, waited


def test_attempts_follow_the_retry_loop(spark):
    rng, rows, heads, want = random.Random(3), [], [], {}
    for c in range(150):
        plain, n = rng.random() < 0.4, rng.choice([1, 3])
        wide = rng.choice([0, 1, 3, 7, 9])
        log = {(k // 3 + 1, k % 3 + 1): rng.choice([None, *ERRORS] if rng.random() < 0.4 else ERRORS) for k in range(wide)}
        rows += [(c, p, a, None if e else f"r{p}{a}", e) for (p, a), e in log.items()]
        heads.append((c, plain, n))
        want[c] = plain_call(log, n, plain)
    heads = spark.createDataFrame(heads, "call_id long, plain boolean, n int")
    heads = heads.select("call_id", "plain", calls.retry_profiles(F.lit("segment"), F.col("n") == 3, F.lit(900)).alias("profiles"))
    log = spark.createDataFrame(rows, "call_id long, profile int, attempt int, response string, error string")
    got = {r.call_id: r for r in calls.resolve_attempts(log, heads).collect()}
    assert {c: (r.outcome, r.attempts, r.waited_ms) for c, r in got.items()} == want
    assert {w[0] for w in want.values()} == {"ok", "open", "stopped", "exhausted"}
    for r in got.values():
        assert (r.response is not None) == (r.outcome == "ok") and (r.profile is None or r.max_tokens == (900, 384, 256)[r.profile - 1])


def test_profiles_of_settings(spark):
    rows = spark.createDataFrame([("segment", True, None, None, None, None), ("optimize", True, 100, 9000, 16, 40), (None, True, 0, 0, 0, -1), ("segment", False, 5, 6, 7, 8), ("analyze", None, 5, 6, 7, 0)], "t string, i boolean, m int, c int, b int, g int")
    got = [[tuple(p) for p in r.p] for r in rows.select(calls.retry_profiles("t", "i", "m", "c", "b", "g").alias("p")).collect()]
    assert got[0] == [(1, None, None, None, None), (2, 384, 2048, 32, 8), (3, 256, 1536, 16, 4)]
    assert got[1] == [(1, 100, 9000, 16, 40), (2, 100, 3072, 16, 12), (3, 100, 2048, 16, 8)]
    assert got[2] == [(1, 0, 0, 0, -1), (2, 1024, 3072, 64, 12), (3, 768, 2048, 32, 8)]
    assert got[3] == [(1, 5, 6, 7, 8)] and got[4] == [(1, 5, 6, 7, 0)]


def test_feeds_ping_while_nothing_comes(spark):
    rng, rows, want = random.Random(8), [], []
    for run in range(40):
        at, ended, last = 0, False, None
        for seq in range(rng.randrange(1, 9)):
            at += rng.choice([0, 1, 24_999_999, 25_000_000, 25_000_001, 80_000_000])
            event = rng.choice(["progress"] * 5 + ["complete", "error"])
            rows.append((run, at, seq, event))
            if ended:
                continue
            if last is not None:
                t = last + 25_000_000
                while t < at:
                    want.append((run, t, "ping"))
                    t += 25_000_000
            want.append((run, at, event))
            last, ended = at, event != "progress"
    rng.shuffle(rows)
    kind = "run long, at long, seq int, event string"
    got = calls.progress_feed(spark.createDataFrame(rows + [(None, 1, 1, "progress"), (1, None, 1, "error")], kind))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 120
    assert calls.progress_feed(spark.createDataFrame([], kind)).count() == 0


def test_previous_speakers_are_those_of_a_sequential_service(spark):
    rng = random.Random(2)
    items, said = [], {}
    for doc in range(12):
        for n in range(1, rng.randrange(2, 40)):
            items.append((doc, n // 17, n, f"q{n:04d}", "head", "body"))
            said[doc, n] = rng.choice(["甲", "乙", "丙", "旁白", "未知"])
    frame = spark.createDataFrame(items, "doc_id long, chapter_idx int, quote_no int, quote_id string, head string, body string")
    placed = quotes.quote_batches(frame, 3)
    answers = spark.createDataFrame([(d, n, s) for (d, n), s in said.items()], "doc_id long, quote_no int, speaker string")
    got = {(r.doc_id, r.quote_no): r.previous for r in quotes.previous_speakers(placed.join(answers, ["doc_id", "quote_no"])).collect()}
    chapters = {}
    for d, c, n, *_ in items:
        chapters.setdefault((d, c), []).append(n)
    for (d, _), ns in chapters.items():
        recent = []
        for b in range(0, len(ns), 3):
            window = recent[-4:]
            for i, n in enumerate(ns[b : b + 3]):
                expected = (window[-1] if window else "（批次首条）") if i == 0 else (window[i - 1] if i - 1 < len(window) else "未知")
                assert got[d, n] == expected
            recent += [said[d, n] for n in ns[b : b + 3] if said[d, n] not in L.FALLBACK_CANDIDATES]
    # a live service is shown the same names
    seen = []

    class Chat:
        def reply(self, prompt):
            names = re.findall(r"(?m)^--- (\d+) \| (\S+) \| head \| (\S+) ---", prompt)
            return "\n".join(f"{i}|{name}|0.9|im|{name}" for i, _, name in names)

    shown = service.attribute_batches(frame.where("doc_id = 1"), Chat(), 3).orderBy("quote_no").collect()
    again = quotes.previous_speakers(placed.join(spark.createDataFrame([(r.doc_id, r.quote_no, r.speaker) for r in shown], "doc_id long, quote_no int, speaker string"), ["doc_id", "quote_no"]))
    assert {r.quote_no: r.previous for r in again.collect()} == {r.quote_no: r.evidence for r in shown} and not seen


def test_prompts_name_the_previous_speaker(spark):
    row = (1, 0, 0, 0, "q0001", ["甲"], ["甲"], "", "", "前", "话", "后", "乙")
    kind = "doc_id long, chapter_idx int, batch_no int, batch_pos int, quote_id string, candidates array<string>, hints array<string>, hint string, warning string, context_before string, text string, context_after string, previous string"
    frame = spark.createDataFrame([row], kind)
    assert codecs.batch_prompt(frame).first().prompt.startswith("--- 1 | q0001 | 甲 | 乙 ---\n")
    assert codecs.batch_prompt(frame.drop("previous")).first().prompt.startswith("--- 1 | q0001 | 甲 ---\n")


def test_chapters_by_brute_force(spark):
    rng, docs = random.Random(6), []
    for d in range(30):
        parts = [rng.choice(["第1章 甲\n", "\n第2章 乙的故事", "  Chapter 3 x\n", "「话」\n", "平常的一行。\n", "\n\n", "序章\n", "x" * 500 + "\n"]) for _ in range(rng.randrange(0, 25))]
        docs.append((d, "".join(parts)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = quotes.extract_quotes(frame)
    head = re.compile(L.CHAPTER_OFFSET.replace("(?md)", "(?m)"))
    texts = dict(docs)
    got = {(r.doc_id, r.quote_id): r.chapter_idx for r in quotes.chapter_of_quotes(frame, found).collect()}
    rows = found.collect()
    assert len(rows) > 30
    for r in rows:
        assert got[r.doc_id, r.quote_id] == sum(m.start() <= r.start for m in head.finditer(texts[r.doc_id]))
    opened = {}
    for r in quotes.chapter_openings(frame).collect():
        opened[r.doc_id, r.chapter_idx] = (r.heading, r.opening)
    want = {}
    for d, text in docs:
        starts = [m.start() for m in head.finditer(text)]
        want[d, 0] = ("", text[: min(400, starts[0] if starts else len(text))])
        for k, at in enumerate(starts, 1):
            upto = starts[k] if k < len(starts) else len(text)
            begin = at + 1 if text[at : at + 1] == "\n" else at
            stop, first = text.find("\n", begin), text.find("\n", at)
            start = at if first < 0 else first
            want[d, k] = ((text[begin:stop] if stop >= 0 else text[begin : begin + 80]).strip(), text[start : min(start + 400, upto)])
    assert opened == want


def test_chapter_openings_grow_with_the_text(spark):
    """4,000 chapters in one document; work in proportion to its length."""
    took = {}
    for n in (1000, 4000):
        book = "".join(f"第{i}章 甲的故事\n" + "他走了。" * 120 + "\n「好」\n" for i in range(n))
        frame = spark.createDataFrame([(1, book)], "doc_id long, text string")
        quotes.chapter_openings(frame).count()
        begun = time.time()
        rows = quotes.chapter_openings(frame).agg(F.count("*"), F.max(F.length("opening")), F.max("heading")).first()
        took[n] = time.time() - begun
        assert rows[0] == n + 1 and rows[1] == 400
        assert quotes.chapter_of_quotes(frame, quotes.extract_quotes(frame)).agg(F.max("chapter_idx"), F.count("*")).first() == (n, n)
    print(took)
    assert took[4000] < 10 * took[1000] + 2
