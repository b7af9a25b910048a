"""Filter audit: all orders against DuckDB and a plain pass, the matrix and its dictionary against counters, awkward inputs."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.llm import audit
from lectern.llm.common import table
from lectern.llm.queries import ORACLES, QUERIES

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

LONG = "Word other things " * 50
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, " ".join(f"w{i}" for i in range(120)), None), (4, None, "de"), (5, "", ""),
    (6, "UPPER $", "en"), (7, "a b  c\x1fd e\x0bf", "de"), (8, "Ünï ÇA " * 60, "fr"), (9, " ".join(f"w{i}" for i in range(100)) + " # Big", "en"),
    (None, LONG, "en"), (10, "x" * 300_000 + " " + "y " * 100_000, "en"), (11, "UPPER $", None),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame([(i, t, g, "p", 1, b"d") for i, t, g in ROWS], "doc_id long, text string, lang string, part string, fails int, digest binary")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def plain(rows, labels):
    """The seven counts by filtering documents one after another."""
    smallest, out = {}, {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    failing = []
    for i, t, g in rows:
        t = t or ""
        w = WORD.findall(t.encode())
        fails = {k for k, f in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > smallest.get(t, i))) if f}
        mine = [x for x in labels if x[0] == i and i is not None]
        failing.append((g or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    for part in {f[0] for f in failing}:
        falls = Counter()
        for order in permutations("ABCDE"):
            left = [f for f in failing if f[0] == part]
            for step, k in enumerate(order, 1):
                hit = [f for f in left if k in f[1]]
                all_ = [f for f in failing if f[0] == part and k in f[1]]
                left = [f for f in left if k not in f[1]]
                falls[k] += len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), len(all_) - len(hit), sum(f[1] == {k} for f in all_), sum(f[2] for f in hit), sum(f[3] for f in hit)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(falls[order[step - 1]])
    return out


def counted(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in df.collect()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES["op12_filter_audit"](spark, sf), con.sql(ORACLES["op12_filter_audit"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("most", [200_000, 0])
def test_awkward_rows_in_every_order(spark, awkward, monkeypatch, most):
    monkeypatch.setattr(audit, "BROADCAST_ROWS", most)
    docs, labels = awkward
    got = counted(audit.interactions(docs, labels))
    assert got == plain(ROWS, LABELS) and len(got) == 600 * 4
    assert audit.interactions(docs.limit(0), labels).count() == 0
    assert counted(audit.interactions(docs, labels.limit(0))) == plain(ROWS, [])


@pytest.mark.parametrize("bits", [63, 6])
def test_codes_are_one_to_one_and_the_matrix_counts_words(spark, awkward, bits):
    """Six bits make nearly all words share a hash with another one."""
    docs, _ = awkward
    own = audit.shared_codes(docs, bits)
    assert (len(own) > 50) == (bits == 6)
    got, meaning = [], {}
    for shard in audit.csr_shards(docs, bits).collect():
        assert len(shard.indptr) == len(shard.doc_id) + 1
        for i, doc in enumerate(shard.doc_id):
            a, b = shard.indptr[i], shard.indptr[i + 1]
            codes = shard.indices[a:b]
            assert codes == sorted(set(codes))
            got.append((doc, dict(zip(codes, shard.counts[a:b]))))
    words = {w for _, t, _ in ROWS for w in WORD.findall((t or "").encode())}
    # one document's words and counts tell its codes' meanings; a code means one word everywhere, and a word has one code
    by_text = {}
    for doc, entry in got:
        by_text.setdefault(doc, []).append(entry)
    for i, t, _ in ROWS:
        want = sorted(Counter(WORD.findall((t or "").encode())).values())
        assert want in [sorted(e.values()) for e in by_text[i]]
    codes = {c for _, e in got for c in e}
    assert len(codes) == len(words)
    for i, t, _ in ROWS:
        seen = set(WORD.findall((t or "").encode()))
        for entry in by_text[i]:
            for c in entry:
                meaning.setdefault(c, words.copy()).intersection_update(seen if len(by_text[i]) == 1 else words)
    assert all(meaning.values())


def test_row_sums_and_nonzero_counts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = sorted((r.doc_id, r.n_words, r.n_distinct) for r in audit.row_flags(audit.csr_shards(docs)).collect())
    want = sorted((r.doc_id, len(w), len(set(w))) for r in docs.collect() for w in [WORD.findall((r.text or "").encode())])
    assert got == want


def test_copies_of_a_large_side_are_not_broadcast(spark, monkeypatch):
    """The planner takes the copies to be as small as the side's files: it would send SALTS times the side through the driver."""
    monkeypatch.setattr(audit, "BROADCAST_ROWS", 0)
    rows = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").cast("binary").alias("digest"))
    side = audit.materialize(spark.createDataFrame([(b"0", 0), (b"1", 1)], "digest binary, first long"), "side")
    joined = audit._beside(rows, side, "digest", F.xxhash64("doc_id"))
    assert sorted((r.doc_id, r.first) for r in joined.collect()) == [(i, i % 3 if i % 3 < 2 else None) for i in range(300)]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
