"""Stages that ask an external service (chat model, entity recogniser), behind small interfaces with offline stubs.

Services run inside tasks, once per partition, on columns cut down to what they need. Filters stand before the stage, as
nothing can be pushed through it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import lexicon as L
from ..functions.text import col


class Chat(Protocol):
    def reply(self, prompt: str) -> str: ...


class Entities(Protocol):
    def names(self, text: str) -> list[str]: ...


class Ranker(Protocol):
    def rank(self, row: dict, usable: list[str], recent: list[str]) -> tuple[str, float, str, str]: ...


class NoEntities:
    def names(self, text: str) -> list[str]:
        return []


class FirstChoice:
    """Takes the first usable name that didn't speak last."""

    def rank(self, row, usable, recent):
        name = next((n for n in usable if n not in L.LOW_VALUE and n != (recent[-1] if recent else None)), None)
        return (name, 0.75, "stub", "implicit") if name else (L.UNKNOWN, 0.2, "stub", "unknown")


class NarratorChat:
    """Replies in the compact form: every numbered line belongs to the narrator. Fails as told, for tests."""

    def __init__(self, most_lines: int | None = None, poison: str | None = None):
        self.most_lines, self.poison = most_lines, poison

    def reply(self, prompt: str) -> str:
        ids = re.findall(r"(?m)^(L\d+): ", prompt)
        if self.poison and self.poison in prompt:
            raise RuntimeError("content_filter")
        if self.most_lines and len(ids) > self.most_lines:
            raise RuntimeError("finish_reason=length")
        return "ROLES: 0=旁白|female\nSEGS:\n" + "\n".join(f"{i} 0 ne h rest" for i in ids)


class Scripted:
    """Any function of the prompt as a service."""

    def __init__(self, answer):
        self.answer = answer

    def reply(self, prompt: str) -> str:
        return self.answer(prompt)


class FirstCandidate:
    """Answers a batch of quotes with the first name that each one lists."""

    def reply(self, prompt: str) -> str:
        items = re.findall(r"(?m)^--- (\d+) \| \S+ \| ([^|、 ]*)", prompt)
        return "\n".join(f"{n}|{name or '未知'}|0.8|im|stub" for n, name in items)


#: What a failure's message holds, by kind, the first kind that fits.
FAILURES = {
    "timeout": ["超时", "timeout", "timed out"],
    "filter": ["content_filter", "内容过滤"],
    "length": ["finish_reason=length", "输出被截断"],
    "transient": ["连接失败", "connection", "主动断开", "remote protocol", "server disconnected", "返回为空", "temporarily", "try again", "rate limit", "429", "500", "502", "503", "504"],
}
#: Model files that could not be fetched when speech recognition began.
RECOGNISER_FAILURES = [
    "connecttimeout", "readtimeout", "timeouterror", "entrynotfounderror", "repositorynotfounderror", "gatedrepoerror", "hfhubhttperror",
    "huggingface", "hf.co", "list_repo_tree", "from_pretrained", "connect timeout", "read timeout", "timed out", "winerror 10060", "connection attempt failed", "automatic-speech-recognition",
]


def failure_kind(message) -> str:
    """timeout, filter, length, transient or decode."""
    m = str(message or "").lower()
    return next((kind for kind, marks in FAILURES.items() if any(x in m for x in marks)), "decode")


def failure_kinds(error):
    """The same as a Column over a table of calls."""
    m = F.lower(F.coalesce(col(error), F.lit("")))
    kind = F.when(F.lit(False), "")
    for name, marks in FAILURES.items():
        kind = kind.when(m.rlike("|".join(re.escape(x) for x in marks)), name)
    return kind.otherwise("decode")


def out_of_memory(error):
    """A graphics device ran out of memory."""
    m = F.lower(F.coalesce(col(error), F.lit("")))
    return F.contains(m, F.lit("out of memory")) & F.contains(m, F.lit("mps"))


def recogniser_failed(error):
    """Speech recognition could not load its model by itself."""
    return F.lower(F.coalesce(col(error), F.lit(""))).rlike("|".join(re.escape(x) for x in RECOGNISER_FAILURES))


def ask(prompts: DataFrame, client: Chat | DataFrame, key: list[str], retries: int = 2) -> DataFrame:
    """prompts (*key, prompt) -> *key, response, error, attempts: an audit row for each call. Timeouts and transient errors
    are retried. In place of a client, a table of recorded replies (*key, response) may stand: an inner join, no call."""
    slim = prompts.select(*key, "prompt")
    if isinstance(client, DataFrame):
        return slim.select(*key).join(client.select(*key, "response"), key).select(*key, "response", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))
    schema = T.StructType([*slim.drop("prompt").schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType()), T.StructField("attempts", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for prompt in pdf.pop("prompt"):
                response = error = None
                for attempt in range(1, retries + 2):
                    try:
                        response, error = client.reply(prompt), None
                        break
                    except Exception as failure:
                        error = str(failure)
                        if failure_kind(error) not in ("timeout", "transient"):
                            break
                out.append((response, error, attempt))
            yield pdf.assign(response=[o[0] for o in out], error=[o[1] for o in out], attempts=pd.array([o[2] for o in out], dtype="int32"))

    return slim.mapInPandas(run, schema)


def recognise(rows: DataFrame, backend: Entities, text: str = "context") -> DataFrame:
    """rows with `entities`, the names that the backend finds in a text column."""
    schema = T.StructType([*rows.schema.fields, T.StructField("entities", T.ArrayType(T.StringType()))])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(entities=[list(dict.fromkeys(backend.names(t or ""))) for t in pdf[text]])

    return rows.mapInPandas(run, schema)


#: Labels of persons, and the fields that hold names and labels, in the replies of recognisers.
PERSON_LABELS = {"PERSON", "PER", "NR", "Nh", "人名", "PERSON_NAME"}
NAME_FIELDS, LABEL_FIELDS = ("text", "word", "span"), ("label", "type", "tag")


def person_names(found) -> list[str]:
    """The person names in a recogniser's reply, in order and once each, however lists and mappings are nested: a tuple whose
    first part is a name and another part a label, or a mapping with both, is a name."""
    label = lambda x: isinstance(x, str) and x.strip() in PERSON_LABELS
    first = lambda x, fields: next((x[k] for k in fields if x.get(k)), None)

    def walk(x):
        if isinstance(x, tuple):
            return [str(x[0]).strip()] if any(label(y) for y in x[1:]) else []
        if isinstance(x, dict):
            name = first(x, NAME_FIELDS)
            if name and label(first(x, LABEL_FIELDS)):
                return [str(name).strip()]
            x = list(x.values())
        return [n for y in x for n in walk(y)] if isinstance(x, list) else []

    return list(dict.fromkeys(n for n in walk(found) if n))


class RecognisedJson:
    """A recogniser whose replies are JSON texts, by any function of the text."""

    def __init__(self, answer):
        self.answer = answer

    def names(self, text: str) -> list[str]:
        return person_names(json.loads(self.answer(text)))


class ChoiceRanker:
    """One candidate of a quote chosen by a chat service among lettered options."""

    def __init__(self, client: Chat, confidence: float = 0.5):
        self.client, self.confidence = client, confidence

    def rank(self, row, usable, recent):
        options = list(dict.fromkeys([*usable, L.UNKNOWN]))[:26]
        shown = "\n".join(f"{chr(65 + i)}. {n}" for i, n in enumerate(options))
        reply = self.client.reply(f"{row.get('context_before', '')}\n句: {row.get('text', '')}\n{row.get('context_after', '')}\n最近: {'、'.join(recent)}\n{shown}")
        letter = re.search(r'choice"?\s*[:=]\s*"?([A-Za-z])', reply)
        sure = re.search(r'confidence"?\s*[:=]\s*"?([0-9.]+)', reply)
        at = ord(letter[1].upper()) - 65 if letter else len(options)
        if at >= len(options):
            return L.UNKNOWN, 0.2, "无法解析选择", "unknown"
        return options[at], _share(sure[1]) if sure else self.confidence, f"选择 {letter[1].upper()}", "implicit"


ATTRIBUTIONS = "doc_id long, quote_no int, speaker string, confidence double, evidence string, attribution_type string"


def attribute_batches(items: DataFrame, client: Chat | DataFrame, size: int = 10, retries: int = 2, kept: int = 8, shown: int = 4) -> DataFrame:
    """Unresolved quotes (doc_id, chapter_idx, quote_no, quote_id, head, body) -> ATTRIBUTIONS.

    A chapter is worked off batch by batch, since each batch is told who spoke in the one before: quote i of a batch sees
    speaker i-1 of that window, the first one sees its last. Quotes without an answer are unknown at .2.

    Recorded replies (doc_id, chapter_idx, batch_no, response) need no order: they are decoded as columns.
    """
    if isinstance(client, DataFrame):
        return _recorded_batches(items, client, size)

    def fold(pdf):
        out, recent = [], []
        rows = pdf.sort_values("quote_no").to_dict("records")
        for b in range(0, len(rows), size):
            batch, window = rows[b : b + size], recent[-shown:]
            said = [window[-1] if i == 0 and window else "（批次首条）" if i == 0 else window[i - 1] if i - 1 < len(window) else L.UNKNOWN for i in range(len(batch))]
            prompt = "\n".join(f"--- {i} | {r['quote_id']} | {r['head']} | {p} ---\n{r['body']}" for i, (r, p) in enumerate(zip(batch, said), 1))
            found = {}
            for _ in range(retries + 1):
                try:
                    found = decode_answers(client.reply(prompt), len(batch))
                except Exception:
                    continue
                if found:
                    break
            for i, r in enumerate(batch):
                speaker, confidence, kind, evidence = found.get(i, (L.UNKNOWN, 0.2, "unknown", ""))
                out.append((r["doc_id"], r["quote_no"], speaker, confidence, evidence, kind))
                if speaker not in L.FALLBACK_CANDIDATES:
                    recent = [*recent, speaker][-kept:]
        return pd.DataFrame(out, columns=[c.split()[0] for c in ATTRIBUTIONS.split(", ")])

    return items.groupBy("doc_id", "chapter_idx").applyInPandas(fold, ATTRIBUTIONS)


def _recorded_batches(items: DataFrame, replies: DataFrame, size: int) -> DataFrame:
    from .codecs import decode_attributions
    from .quotes import quote_batches

    placed = quote_batches(items.select("doc_id", "chapter_idx", "quote_no", "quote_id"), size)
    key = ["doc_id", "chapter_idx", "batch_no"]
    asked = placed.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("batch_pos", "quote_id"))), lambda x: x["quote_id"]).alias("quote_ids"))
    said = decode_attributions(asked.join(replies, key).select(F.struct("doc_id", "chapter_idx").alias("batch_id"), "quote_ids", "response"))
    answers = said.select(F.col("batch_id.doc_id").alias("doc_id"), "quote_id", "speaker", "confidence", "evidence", "attribution_type")
    full = placed.join(answers, ["doc_id", "quote_id"], "left")
    given = {"speaker": L.UNKNOWN, "confidence": 0.2, "evidence": "", "attribution_type": "unknown"}
    return full.select("doc_id", "quote_no", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in given.items()])


#: A row of an answer: place, speaker, confidence, type and, if there is one, evidence.
ANSWER = re.compile(r"(?m)^(?!\s*#)(?P<place>[^|\n]*[0-9][^|\n]*)\|(?P<speaker>[^|\n]*)\|(?P<sure>[^|\n]*)\|(?P<kind>[^|\n]*)(?:\|(?P<evidence>[^|\n]*))?")
THOUGHT = re.compile(r"(?s)<think>.*?(?:</think>|\Z)")


def _share(text: str) -> float:
    """A number cut to 0..1; 0.5 for what is none."""
    try:
        number = float(text)
    except ValueError:
        return 0.5
    return min(max(number, 0.0), 1.0) if number == number else 0.5


def decode_answers(reply: str, n: int) -> dict[int, tuple[str, float, str, str]]:
    """Answers by 0-based place, the last of a place counts: what codecs.decode_attributions() does with columns, for the one
    stage whose next question needs the answers to this one."""
    found = ((int(re.sub("[^0-9]", "", m["place"])), m) for m in ANSWER.finditer(THOUGHT.sub("", reply).replace("\r", "\n")))
    return {at - 1: (m["speaker"].strip(), _share(m["sure"]), L.TYPE_CODES.get(m["kind"].strip(), "implicit"), (m["evidence"] or "").strip()) for at, m in found if 1 <= at <= n}


#: After a failure a chunk is cut to (characters, lines): of the budget, by kind.
def smaller(kind: str, budget: int, lines: int) -> tuple[int, int]:
    if kind == "filter":
        return 320, 1
    if kind == "length":
        return 320, 6
    if kind == "timeout" and lines > 36:
        return max(800, budget - 200), 36
    return max(500, budget // 2), 24


def context_groups(chunks: DataFrame, mode: str = "chapter") -> DataFrame:
    """chunks (doc_id, chunk_idx, title, …) with group_no: chunks of one group are worked off one after another and share
    their context. `off` parts all chunks, `full` none, `chapter` keeps consecutive chunks of one chapter together."""
    from ..functions.text import chapter_key
    from .segments import consecutive_groups

    if mode == "off":
        return chunks.withColumn("group_no", F.col("chunk_idx") + 1)
    if mode == "full":
        return chunks.withColumn("group_no", F.lit(1))
    return consecutive_groups(chunks, chapter_key("title"))


SEGMENTS = "doc_id long, chunk_idx int, seq int, speaker string, style string, emotion string, confidence_label string, text string, line_id string, skip_reason string"


def analyse_chunks(lines: DataFrame, client: Chat, budget: int = 1200, most_lines: int = 48, by=("doc_id", "chunk_idx")) -> DataFrame:
    """Numbered lines (doc_id, chunk_idx, line_no, line_id, text) -> SEGMENTS.

    A group (a chunk, or what context_groups() made if `by` says so) is worked off in order, as replies feed the next question. What fails is
    cut smaller and asked again, first part first; what cannot be cut is kept as UNKNOWN lines with the reason, so no text is
    lost. Each cut is strictly smaller, so the work ends.
    """
    groups = list(by)

    def parts(rows, chars, count):
        out, size = [[]], 0
        for r in rows:
            if out[-1] and (len(out[-1]) >= count or size + max(1, len(r[3])) > chars):
                out.append([])
                size = 0
            out[-1].append(r)
            size += max(1, len(r[3]))
        return [p for p in out if p]

    def fold(pdf):
        pdf = pdf.sort_values(["chunk_idx", "line_no"])
        done, doc, active = [], int(pdf.doc_id.iloc[0]), []
        for chunk, part in pdf.groupby("chunk_idx", sort=True):
            seq = 0
            rows = list(part[["line_no", "line_id", "chunk_idx", "text"]].itertuples(index=False, name=None))
            work = parts(rows, 2 * budget, most_lines)[::-1]
            while work:
                piece = work.pop()
                prompt = (f"CTX\n活跃: {', '.join(active[:3])}\n\n" if active else "") + "\n".join(f"L{i}: {r[3]}" for i, r in enumerate(piece, 1))
                try:
                    found = decode_reply(client.reply(prompt), [r[3] for r in piece])
                except Exception as failure:
                    kind = failure_kind(failure)
                    cut = parts(piece, *smaller(kind, budget, len(piece)))
                    if len(cut) < 2 and len(piece) > 1:
                        cut = [piece[: len(piece) // 2], piece[len(piece) // 2 :]]
                    if len(cut) > 1:
                        work.extend(cut[::-1])
                        continue
                    found = [(i, "UNKNOWN", "female, moderate pitch", "neutral", "low", r[3], kind) for i, r in enumerate(piece)]
                for i, speaker, style, emotion, sure, text, reason in found:
                    seq += 1
                    done.append((doc, int(chunk), seq, speaker, style, emotion, sure, text, piece[i][1], reason))
                    if speaker not in L.REGISTRY_SKIP:
                        active = [speaker, *[a for a in active if a != speaker]]
        return pd.DataFrame(done, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return lines.select("doc_id", "chunk_idx", "line_no", "line_id", "text", *[c for c in groups if c not in ("doc_id", "chunk_idx")]).groupBy(*groups).applyInPandas(fold, SEGMENTS)


def decode_reply(reply: str, lines: list[str]):
    """(line index, speaker, style, emotion, confidence, text, None) of a compact reply over lines; ValueError if empty.

    The same format as codecs.decode_segments(), for use inside a sequential stage.
    """
    roles, out, at = {"0": ("旁白", "female moderate pitch")}, [], {}
    for entry in re.findall(r"(?m)^\s*ROLES:(.*)$", reply):
        for item in entry.split(","):
            key, eq, rest = item.partition("=")
            if eq and key.strip():
                name, _, style = rest.partition("|")
                roles[key.strip()] = (name.strip() or "UNKNOWN", style.replace("_", " ").strip())
    for m in re.finditer(r"(?m)^\s*L(\d+)(?:-L(\d+))?[ \t]+(\S+)[ \t]+(\S+)(?:[ \t]+([^\n]*))?$", reply):
        first, last = int(m[1]), int(m[2] or m[1])
        last = last if first <= last <= len(lines) else len(lines)
        code, _, anchor = (m[5] or "").strip().partition(" ")
        sure = L.CONFIDENCE_CODES.get(code)
        anchor = anchor.strip() if sure else (m[5] or "").strip()
        speaker, style = ("旁白", roles["0"][1]) if m[3] == "0" else ("UNKNOWN", "") if m[3] == "?" else roles.get(m[3], ("UNKNOWN", ""))
        for i in range(first - 1, last) if 1 <= first <= len(lines) else ():
            begin, line = at.get(i, 0), lines[i]
            hit = line.find(anchor[1:-1], begin) if len(anchor) > 2 and anchor[0] == anchor[-1] == '"' else -1
            at[i] = hit + len(anchor) - 2 if hit >= 0 else len(line)
            if line[begin : at[i]].strip():
                out.append((i, speaker, style, L.EMOTION_CODES.get(m[4].lower(), "neutral"), sure or "high", line[begin : at[i]].strip(), None))
    if not out:
        raise ValueError("empty compact reply")
    return out
