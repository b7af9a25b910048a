"""Periodic runs: extensions and runs against brute force, whole documents against plain Python, awkward inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lectern.llm import repetition as R
from lectern.llm.common import table
from lectern.llm.queries import QUERIES

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """For each period the stretches of words that equal the one a period on; of a stretch the smallest period."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j - i + p), p)
            i = j
    return sorted(((s, n_, p) for (s, n_), p in found.items() if n_ >= max(12, 2 * p)), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, rewrite):
    words = SPLIT.findall(text or "")
    n = len(words)
    if rewrite and n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, n_, p in runs for i in range(s + p, s + n_)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, sha("".join(f"{s},{n_},{p}\n" for s, n_, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_every_pair_of_residues_meets_the_cover():
    for a in range(R.COVER):
        for b in range(R.COVER):
            t = R.SHIFT[a, b]
            assert (a + t) % R.COVER in R.RESIDUES and (b + t) % R.COVER in R.RESIDUES


@pytest.mark.parametrize("seed", range(6))
def test_extensions_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, (1, 2, 3, 50, 2, 2)[seed], 400)
    if seed > 3:
        ids = np.tile(ids[: 40 + 51 * (seed - 4)], 10)[:400]
    ids = np.append(ids, 10_000)
    lce = R.Extensions(ids)
    order = sorted(lce.sampled.tolist(), key=lambda i: ids[i:].tolist())
    assert [order[r] for r in lce.rank] == lce.sampled.tolist()
    a, b = rng.integers(0, 401, 3000), rng.integers(0, 401, 3000)
    a, b = a[a != b], b[a != b]

    def plain(i, j):
        n = 0
        while max(i, j) + n < len(ids) and ids[i + n] == ids[j + n]:
            n += 1
        return n

    assert lce(a, b).tolist() == [plain(i, j) for i, j in zip(a, b)]


def made(rng):
    kind = rng.randrange(6)
    few = lambda k, n: [rng.choice("abcdefgh"[:k]) for _ in range(n)]
    if kind == 0:
        return few(1, rng.randrange(0, 40))
    if kind == 1:
        return few(2, rng.randrange(0, 200))
    if kind == 2:
        return few(3, 5) + few(4, rng.randrange(1, 30)) * rng.randrange(2, 9) + few(3, 9)
    if kind == 3:
        inner = few(2, 3) * 3 + few(3, 4)
        return inner * rng.randrange(2, 8) + few(5, 5)
    if kind == 4:
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randrange(3, 10)):
            a, b = b, b + a
        return b[:400]
    return [str(rng.randrange(60)) for _ in range(rng.randrange(0, 300))]


@pytest.mark.parametrize("size", [1 << 16, 64])
def test_runs_of_made_documents(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(R, "GROUP_WORDS", size)
    rng = random.Random(7)
    docs = [made(rng) for _ in range(250)]
    runs, texts = R.runs_of_batch(pa.array([rng.choice([" ", "\n", " \t "]).join(d) for d in docs]), list(range(len(docs))))
    for words, got, text in zip(docs, runs, texts):
        want = plain_runs(words)
        assert [tuple(x) for x in got.T.tolist()] == want
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert text.decode() == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert sum(r.shape[1] for r in runs) > 300


def test_small_blocks_of_pairs_give_the_same(monkeypatch):
    rng = random.Random(11)
    for _ in range(20):
        words = np.array([int(rng.random() < 0.5) for _ in range(300)] * 3)
        line = np.concatenate([[7], words, [8]])
        monkeypatch.setattr(R, "PAIRS", 1 << 20)
        whole = R.find_runs(line, len(words) // 2)
        monkeypatch.setattr(R, "PAIRS", 100)
        assert (R.find_runs(line, len(words) // 2) == whole).all()


def test_query_on_the_smallest_tables_by_brute_force(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs) and sum(r[1] for r in got.values()) > 20
    for r in docs:
        if len(r.text or "") < 12_000:
            assert got[r.doc_id] == plain_row(r.doc_id, r.text, True)


def test_awkward_rows(spark):
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a " * 11), (6, "a " * 12), (7, "x\x1fy z\x85 " * 8), (8, "word " * 200_000), (9, "ü é " * 30), (4, "one"), (4, "b c " * 9), (None, "p q r " * 10), (10, "w" * 2_000_000 + " end"), (11, " ".join(map(str, range(30_000))) + " tick tock" * 40), (-5, "minus " * 20)]
    odd = spark.createDataFrame([(i, t, 3, "r") for i, t in texts], "doc_id long, text string, start int, runs string")
    for rewrite in (None, R.rewritten):
        got = sorted((tuple(r) for r in R.periodic_runs(odd, rewrite).collect()), key=repr)
        small = [t for t in texts if len(t[1] or "") < 100_000]
        want = [plain_row(i, t, rewrite is not None) for i, t in small]
        assert len(got) == len(texts) and not set(want) - set(got)
    long_ = {r[0]: r for r in got}
    assert long_[8][1] == 1 and long_[8][4] in (1, 200_000) or long_[8][3] == 200_000
    assert long_[11][1] >= 1 and long_[10][1] == 0
    assert R.periodic_runs(odd.limit(0)).count() == 0


def test_collapse_keeps_text_and_runs(spark):
    docs = spark.createDataFrame([(1, "say so " + "again and " * 9 + "stop"), (2, None), (3, "no run  here")], "doc_id long, text string")
    got = {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in R.collapse(docs).collect()}
    assert got == {1: ("say so again and stop", [(2, 18, 2)]), 2: (None, []), 3: ("no run here", [])}
