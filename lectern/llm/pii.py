"""Personal data: fixed patterns per kind, and a skip-chain conditional random field that adds what they miss.

Nodes are the spans of the patterns and other number-like or address-like tokens of a document. Chain edges join
neighbours; skip edges join consecutive mentions with equal content, and consecutive ones with similar content, wherever they
stand; loopy message passing then makes labels agree along all of them. Spans of the patterns are evidence and always stay.

All potentials are fitted together by pseudo-likelihood: each node of known label is predicted from its shape and its
neighbours' labels. Mentions are masked for that: a share of the pattern spans is repeated in a form that no pattern takes,
with the span's label as the truth, next to a stranger of the same form, so what the field must do later is what it is
fitted to do. A token that no pattern takes
counts as a negative only if nothing like it is personal data.

Defined results
* null text is empty: no spans, all counts 0, digest of the empty string;
* n_email, n_ip, n_card, n_phone and base_sha256 cover the pattern spans; `spans` covers these and the added ones;
* offsets are code points, ends exclusive; spans are ordered by kind (email, ip, card, phone), then start;
* every row is judged for itself, repeated rows alike; a null doc_id stays null; an empty table gives an empty result;
  other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does; possessive runs keep the scan linear.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens that may be personal data although no pattern takes them: addresses, dotted quads, grouped and plain numbers.
OTHER = re.compile(r"(?P<email>[^\s@|\",;<>()]{1,64}@[^\s@|\",;<>()]{0,255}[A-Za-z0-9])|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})|(?P<phone>\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4})|(?P<card>[0-9]{7,19})")
_DIGITS = re.compile(r"[0-9]")
#: The field is fitted on the nodes of about so many documents, drawn by the hash of doc_id.
TRAIN_DOCS, EPOCHS, RATE = 4000, 300, 0.5
#: Masked repetitions of pattern spans in training, and how much a masked one counts.
MASK_SHARE, MASK_WEIGHT = 0.5, 4.0
#: Messages are passed until none changes by more than TOLERANCE, at most SWEEPS times.
SWEEPS, TOLERANCE = 500, 1e-4
LABELS = 1 + len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of local part, @, domain: each @ is tried once, so long words cost no more than their length."""
    end, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > end and text[first - 1] in LOCAL_PART:
            first -= 1
        domain = DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            yield first, domain.end()
            end = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the patterns' valid matches, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if _DIGITS.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m.group())) <= 15]
    return out


def digest_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _features(piece: str) -> list[int]:
    """Numbers of the features that hold for a node."""
    digits = "".join(_DIGITS.findall(piece))
    n = len(digits)
    return [0, 1 + min(n, 20), 22 + ("@" in piece), 24 + min(piece.count("."), 4), 29 + ("(" in piece or ")" in piece), 31 + piece.startswith("+"), 33 + (16 <= n <= 19 and luhn(digits)), 35 + (" " in piece or "-" in piece)]


FEATURES = 37


CHAIN, EQUAL, SIMILAR = range(3)


def _keys(piece: str) -> tuple[set[str], set[str]]:
    """What a mention shares with others of equal, and of similar content."""
    digits = "".join(_DIGITS.findall(piece))
    if "@" in piece:
        local = piece.lower().partition("@")[0]
        return {piece.lower()}, {f"local:{local}"} if len(local) >= 4 else set()
    if "." in piece and piece.count(".") == 3:
        return {digits + piece}, {"net:" + piece.rpartition(".")[0]}
    if len(digits) < 7:
        return set(), set()
    return {digits[-10:]}, {"tail:" + digits[-7:]} | ({"head:" + digits[:8]} if len(digits) >= 12 else set())


def masked_form(kind: int, piece: str, draw: float) -> str | None:
    """A form of a pattern span that no pattern takes, as texts have them; None if there is none."""
    digits = "".join(_DIGITS.findall(piece))
    if kind == 0:
        return piece.partition("@")[0] + "@" + piece.partition("@")[2].partition(".")[0]
    if kind == 2:
        return digits[:-1] if draw < 0.5 else digits[-12:]
    if kind == 3:
        tail = digits[-10:]
        return tail if draw < 0.3 or len(tail) < 10 else f"{tail[:3]} {tail[3:6]}-{tail[6:]}" if draw < 0.7 else f"({tail[:3]}) {tail[3:6]}-{tail[6:]}"
    return None


class Nodes:
    """Nodes and edges of documents, appended one document after another."""

    def __init__(self):
        self.spans, self.doc, self.observed, self.truth, self.features = [], [], [], [], []
        self.edges: list[tuple[int, int, int]] = []

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]], masks=None) -> None:
        """With `masks`, a random source, masked repetitions of pattern spans are added as nodes of known label."""
        if not base and "@" not in text and not _DIGITS.search(text):
            return
        merged: list[list[int]] = []
        for a, b in sorted((a, b) for _, a, b in base):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        found = [(a, b, k + 1, k + 1, text[a:b]) for k, a, b in base]
        at = 0
        for m in OTHER.finditer(text):
            a, b = m.span()
            while at < len(merged) and merged[at][1] <= a:
                at += 1
            if at == len(merged) or merged[at][0] >= b:
                found.append((a, b, 0, 0, m.group()))
        if masks is not None:
            for k, a, b in base:
                form = masked_form(k, text[a:b], masks.random()) if masks.random() < MASK_SHARE else None
                if form:
                    # a stranger of the same shape is no personal data of this document, so shapes alone decide nothing
                    strange = "".join(str(masks.randrange(10)) if c.isdigit() else chr(97 + masks.randrange(26)) if c.isalpha() else c for c in form)
                    found += [(at_, at_, 0, label, x) for at_, label, x in ((masks.randrange(len(text) + 1), k + 1, form), (masks.randrange(len(text) + 1), 0, strange))]
        found.sort(key=lambda x: x[:3])
        first, groups = len(self.spans), {}
        last: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for i, (a, b, label, truth, piece) in enumerate(found):
            node = first + i
            self.spans.append((a, b))
            self.doc.append(doc)
            self.observed.append(label)
            self.truth.append(truth)
            self.features.append(_features(piece))
            if i:
                self.edges.append((node - 1, node, CHAIN))
            for seen, keys, kind in zip(last, _keys(piece), (EQUAL, SIMILAR)):
                for key in sorted(keys):
                    if key in seen:
                        self.edges.append((seen[key], node, kind))
                    seen[key] = node
                    groups.setdefault(key, []).append(node)
        # what looks like personal data of this document is no negative; a masked form keeps its label
        for members in groups.values():
            if any(self.observed[n] for n in members):
                for n in members:
                    if not self.observed[n] and not self.truth[n]:
                        self.truth[n] = -1

    def arrays(self):
        edges = np.array(self.edges, np.int64).reshape(-1, 3)
        return np.array(self.observed, np.int64), np.array(self.truth, np.int64), np.array(self.features, np.int64).reshape(-1, 8), edges


class Field:
    """Unary weights (FEATURES x LABELS) and an agreement weight for each kind of edge."""

    def __init__(self, unary: np.ndarray, agree: np.ndarray):
        self.unary, self.agree = unary, np.asarray(agree, float)

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Loopy sum-product over all documents at once; documents share no edge. Exact where edges make no loop."""
        observed, _, features, edges = nodes.arrays()
        local = self.unary[features].sum(axis=1)
        seen = np.flatnonzero(observed)
        local[seen, observed[seen]] += 25.0
        n, weight = len(edges), self.agree[edges[:, 2]]
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(n) + n, np.arange(n)])
        gain = np.expm1(np.concatenate([weight, weight]))[:, None]
        message = np.zeros((2 * n, LABELS))
        for _ in range(SWEEPS if n else 0):
            total = local.copy()
            np.add.at(total, dst, message)
            out = total[src] - message[back]
            p = np.exp(out - out.max(axis=1, keepdims=True))
            fresh = np.log(p.sum(axis=1, keepdims=True) + gain * p)
            fresh -= fresh.max(axis=1, keepdims=True)
            moved = np.abs(fresh - message).max()
            message = 0.5 * message + 0.5 * fresh
            if moved < TOLERANCE:
                break
        np.add.at(local, dst, message)
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_field(nodes: Nodes) -> Field:
    """All potentials together, by the pseudo-likelihood of nodes whose label is known given their neighbours'."""
    observed, truth, features, edges = nodes.arrays()
    unary, agree = np.zeros((FEATURES, LABELS)), np.full(3, 0.5)
    unary[0, 0] = 2.0
    if not len(observed):
        return Field(unary, agree)
    near = np.zeros((3, len(truth), LABELS))
    for a, b in (edges[:, :2].T, edges[:, 1::-1].T):
        known = truth[b] >= 0
        np.add.at(near, (edges[known, 2], a[known], truth[b][known]), 1.0)
    rows = np.flatnonzero(truth >= 0)
    weight = np.where((observed[rows] == 0) & (truth[rows] > 0), MASK_WEIGHT, 1.0)[:, None]
    weight = weight / weight.sum()
    goal, shape, near = np.eye(LABELS)[truth[rows]], features[rows], near[:, rows]
    for _ in range(EPOCHS):
        z = unary[shape].sum(axis=1) + np.tensordot(agree, near, 1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - goal) * weight
        grad = np.zeros_like(unary)
        np.add.at(grad, shape, d[:, None, :])
        unary -= RATE * (grad + 1e-4 * unary)
        # neighbours never repel, so messages stay well defined
        agree = np.maximum(agree - RATE * ((near * d).sum(axis=(1, 2)) + 1e-4 * agree), 0.0)
    return Field(unary, agree)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Fit on a bounded draw of documents that hold a digit or an @; only their nodes come to the driver."""
    some = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    n = some.count()
    drawn = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, train_docs / max(1, n)) * (1 << 20))

    def nodes_of(batches):
        import random

        import pyarrow as pa

        kinds = [pa.int64()] + [pa.list_(pa.int64())] * 4
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                nodes, body = Nodes(), text.as_py()
                nodes.add(0, body, base_spans(body), random.Random(doc_id))
                rows.append((doc_id, nodes.observed, nodes.truth, [x for f in nodes.features for x in f], [x for e in nodes.edges for x in e]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["doc_id", "o", "t", "f", "e"])

    whole = Nodes()
    for r in sorted(drawn.mapInArrow(nodes_of, "doc_id long, o array<long>, t array<long>, f array<long>, e array<long>").collect()):
        first = len(whole.observed)
        whole.observed += r["o"]
        whole.truth += r["t"]
        whole.features += [r["f"][i : i + 8] for i in range(0, len(r["f"]), 8)]
        whole.edges += [(r["e"][i] + first, r["e"][i + 1] + first, r["e"][i + 2]) for i in range(0, len(r["e"]), 3)]
    return fit_field(whole)


def all_spans(texts: list[str], field: Field) -> tuple[list, list]:
    """Base spans and base plus added spans of each text."""
    nodes, base = Nodes(), [base_spans(t) for t in texts]
    for i, t in enumerate(texts):
        nodes.add(i, t, base[i])
    every = [list(b) for b in base]
    if nodes.spans:
        p = field.marginals(nodes)
        label = p.argmax(axis=1)
        for i in np.flatnonzero((np.array(nodes.observed) == 0) & (label > 0)):
            every[nodes.doc[i]].append((int(label[i]) - 1, *nodes.spans[i]))
    return base, [sorted(x) for x in every]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """documents -> doc_id, counts and digest of the pattern spans, all spans, how many were added, and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            base, every = all_spans(texts, shared.value)
            counts = [pa.array([sum(1 for s in b if s[0] == k) for b in base], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(digest_text(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([digest_text(e) for e in every], pa.string()), pa.array([len(e) - len(b) for b, e in zip(base, every)], pa.int64()), pa.array([len(e) for e in every], pa.int64())], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
