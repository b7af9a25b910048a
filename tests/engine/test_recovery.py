"""Arrays out of noisy replies, against a plain scan from the right."""

import json
import random
import re

from pyspark.sql import functions as F

from lectern.operators import codecs


def plain(text):
    if text is None:
        return None
    text = re.sub(r"(?s)<think>.*?(</think>|\Z)", "", text).strip()
    fence = re.search(r"(?s)```(?:json)?\s*(\[.*?\])\s*```", text)
    pieces = [fence[1]] if fence else []
    for at in sorted((m.start() for m in re.finditer(r"\[", text)), reverse=True):
        depth = 0
        for i in range(at, len(text)):
            depth += (text[i] == "[") - (text[i] == "]")
            if not depth:
                pieces.append(text[at : i + 1])
                break
    for piece in pieces:
        try:
            json.loads(piece)
            return piece
        except ValueError:
            pass
    return None


def test_array_recovery_on_named_and_random_replies(spark):
    rng = random.Random(5)
    bits = ["[", "]", "[1, 2]", '["a"]', '[{"id": "q1"}]', " so ", "```json\n", "```", "<think>", "</think>", "{", "}", '"x]"', ",", "\n", "[]", "人", "😀"]
    named = [
        "first [1,2] last [3,4]", '```json\n[{"a": 1}, {"a": [2]}]\n```', "<think>[1</think>[2]", "[5]<think>[6]", "", "no array", "[[1, 2], [3]]", "[1, [2]", "] [7] [", "```\n[1, x]\n``` [8]",
        "[" * 500 + "1" + "]" * 500, '[{"s": "a]"}]', "x" * 9000 + "[" + ", ".join(map(str, range(3000))) + "]" + "y" * 9000,
    ]
    texts = named + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(400)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", codecs.recover_array("t").alias("a")).collect()
    got = {r.i: r.a for r in rows}
    assert [got[i] for i in range(len(texts))] == [plain(t) for t in texts]
    assert got[0] == "[3,4]" and got[3] == "[5]" and sum(v is not None for v in got.values()) > 100


def test_answers_are_read_out_of_prose(spark):
    reply = 'I think [maybe] so:\n```json\n[{"id": 2, "speaker": " 甲 ", "confidence": 7}, {"id": "q1"}]\n``` done [0'
    rows = spark.createDataFrame([(1, ["q1", "q2"], reply), (2, ["q1"], "[1, 2]"), (3, ["q1"], None)], "batch_id long, quote_ids array<string>, response string")
    got = sorted(tuple(r) for r in codecs.decode_json_attributions(rows).collect())
    assert got == [(1, "q1", "未知", 0.5, "implicit", ""), (1, "q2", "甲", 1.0, "implicit", "")]


def plain_object(text):
    if text is None:
        return None
    text = text.strip()

    def snippet():
        for a, b in ("{}", "[]"):
            at = text.find(a)
            depth = quoted = skip = 0
            for i in range(at, len(text)) if at >= 0 else ():
                c = text[i]
                if quoted:
                    quoted, skip = not (c == '"' and not skip), c == "\\" and not skip
                elif c == '"':
                    quoted = 1
                else:
                    depth += (c == a) - (c == b)
                    if not depth:
                        return text[at : i + 1]

    for piece in (text, snippet()):
        try:
            found = json.loads(piece)
        except (TypeError, ValueError):
            continue
        return piece if isinstance(found, dict) else f'{{"segments": {piece}}}' if isinstance(found, list) else None
    return None


def test_reply_objects(spark):
    rng = random.Random(6)
    bits = ["{", "}", '{"a": 1}', '{"a": "}"}', "[", "]", "[1]", '"', "\\", '\\"', " ok ", '{"k": {"z": [2]}}', "5", ":", ",", "人"]
    named = ['{"a": 1}', "[1, 2]", 'so {"a": "x}y\\"{"} end', "5", '"s"', "", "none", '{"a": 1', "list [1, {}] then", '{"a": 1} {"b": 2}', "[1] {x}", '{"t": "' + "\\n" * 6000 + '"} z', "{" * 300 + "}" * 300, '{"a": "open']
    texts = named + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(400)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", codecs.reply_object("t").alias("a")).collect()
    got = {r.i: r.a for r in rows}
    assert [got[i] for i in range(len(texts))] == [plain_object(t) for t in texts] and sum(v is not None for v in got.values()) > 60


def test_fixes_and_guesses_in_json(spark):
    reply = 'Well: {"corrections": [{"index": 0, "suggested_speaker": " 甲 ", "confidence": "HIGH"}, {"index": "1", "suggested_speaker": "乙", "confidence": "low"}, {"index": 0, "suggested_speaker": "丙", "confidence": "high"}, {"suggested_speaker": "丁", "confidence": "high"}]} ok'
    rows = spark.createDataFrame([(1, 0, reply), (2, 0, "none"), (3, 0, "{}"), (4, 0, None)], "doc_id long, window_start int, response string")
    assert [tuple(r) for r in codecs.decode_json_fixes(rows).collect()] == [(1, 0, 0, "丙")]
    guess = spark.createDataFrame([('{"pattern": " x ", "reason": 5}',), ("[]",), ("?",), (None,)], "t string").select(codecs.decode_json_guess("t").alias("g")).collect()
    assert [r.g and tuple(r.g) for r in guess] == [("x", "", "5"), ("none", "", ""), None, None]


def test_no_python_worker(spark):
    plan = spark.createDataFrame([("[1]",)], "t string").select(codecs.recover_array(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
