"""MinHash near-duplicates, line dedup, decontamination and top-k against brute force, with awkward inputs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lectern.llm import decontaminate, lines, minhash, topk
from lectern.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, kept string, bucket string, h1 string, __gone_key string, __gone string, __GONE_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", "y", "z", "w", "g", "i") for i, t, s in rows], DOCS)


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n)]


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows():
    rng, rows = random.Random(4), []
    for g in range(8):
        base = words(rng, 120)
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(99))
            rows.append(" ".join(copy))
    common = words(rng, 60)
    rows += [" ".join(common + words(rng, 30)) for _ in range(20)]
    rows += [None, "", "  \t\n", "one two", "One TWO", "ÀÉ two", "one", "   ", " ".join(words(rng, 30_000))]
    return list(enumerate(rows))


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    got = minhash.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_large_bucket(spark, monkeypatch):
    """Chains of copies in one bucket: members that the pivot doesn't reach are still linked."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng, rows = random.Random(9), []
    base = words(rng, 200)
    for i in range(40):
        rows.append((i, " ".join(base)))
        for _ in range(2):
            base[rng.randrange(len(base))] = f"new{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_beyond_the_bounds(spark, monkeypatch):
    """The ways for large data: ids that are not broadcast, pivots dealt into groups, classes too hot for one task."""
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(minhash, "GROUP", 2)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = near_rows()
    rows += [(1000 + i, rows[3][1]) for i in range(30)]
    for hot in (3, 1_000_000):
        monkeypatch.setattr(minhash, "HOT_ROWS", hot)
        got = minhash.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows])).collect()
        assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_scratch_tables_are_deleted(spark):
    import os

    from lectern.llm.common import clear_scratch, shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    minhash.near_duplicates(frame(spark, [(1, "a b c d e f", "s"), (2, "a b c d e f", "s")])).collect()
    clear_scratch(spark)
    assert not [f for f in os.listdir(folder) if f.startswith("minhash")]


def test_near_duplicates_of_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g"
    got = minhash.near_duplicates(frame(spark, [(5, text, "s"), (5, text, "s"), (7, text, "s"), (None, text, "s")])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("None", None, None)]
    docs = frame(spark, [(5, text, "s"), (7, text, "s"), (None, text, "s")])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "None"]
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def test_a_doc_id_that_repeats_with_different_texts_is_several_documents(spark):
    """Rows are compared by their own texts, whichever ids they carry; ids are compared only at the end."""
    rng = random.Random(12)
    base = [" ".join(words(rng, 60)) for _ in range(6)]
    near = lambda t: t + " tail"
    rows = [(5, base[0]), (5, base[1]), (7, near(base[1])), (3, base[2]), (5, base[2]), (9, base[0].upper()), (8, near(base[0])), (5, base[3]), (2, near(base[3])), (-4, base[4]), (-4, base[5]), (6, near(base[5])), (1, base[4] + " x y"), (5, base[1])]
    nodes = brute_components([(k, t) for k, (_, t) in enumerate(rows)])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[nodes[k][1]] = min(least.get(nodes[k][1], i), i)
    want = sorted((i, nodes[k][0], least[nodes[k][1]], i == least[nodes[k][1]]) for k, (i, _) in enumerate(rows))
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == want
    assert (7, 57, 5, False) in want and (2, 57, 2, True) in want
    kept = sorted((r.doc_id, r.text) for r in minhash.keep_one(docs).collect())
    assert kept == sorted((i, t) for k, (i, t) in enumerate(rows) if i == least[nodes[k][1]])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    one = np.unique(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    two = np.concatenate([one[:700], np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))])
    share = (minhash.signature(one) == minhash.signature(two)).mean()
    assert abs(share - 700 / 1100) < 0.1
    bounds = dict(minhash.prune_bounds())
    assert bounds[32] < 24 and bounds[288] < 0.75 * 288


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_lines_of_many_sites_keep_one_occurrence(spark):
    rows = [(i, f"own line number {i}\nCommon  footer line\n\nx", f"site{i}") for i in range(12)]
    rows += [(50, "Rare shared line\ncommon FOOTER line\nCommon footer line", "site0"), (51, "Rare shared line", "site1"), (52, None, "s"), (53, "", "s"), (54, "common footer line", None), (None, "common footer line", "s")]
    docs = frame(spark, rows)
    got = lines.clean_lines(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[0] == rows[0][1] and text[3] == "own line number 3\n\nx"
    assert text[50] == "Rare shared line" and text[51] == "Rare shared line"
    assert text[52] is None and text[53] == "" and text[54] == "" and text[None] == "common footer line"
    assert lines.clean_lines(frame(spark, [])).collect() == []


def test_lines_beyond_the_bounds(spark, monkeypatch):
    """Keys and removals that are not broadcast, and a very long text, give the same as brute force."""
    rng = random.Random(6)
    shared = [f"shared line number {k}" for k in range(6)]
    rows = [(i, "\n".join(rng.choice(shared + [f"own line {i} {j}"]) for j in range(8)), f"site{rng.randrange(9 + i % 7)}") for i in range(120)]
    rows.append((500, "\n".join(rng.choice(shared) if j % 50 == 0 else f"long text line {j}" for j in range(60_000)), "site1"))
    where = defaultdict(list)
    for i, t, s in sorted(rows):
        for pos, line in enumerate(t.split("\n")):
            where[line].append((i, pos, s))
    gone = {(i, pos) for places in where.values() if len({s for _, _, s in places}) >= 10 for i, pos, _ in places[1:]}
    want = {i: "\n".join(x for pos, x in enumerate(t.split("\n")) if (i, pos) not in gone) for i, t, _ in rows}
    for name, value in (("BROADCAST_KEYS", 0), ("BROADCAST_REMOVALS", 0), ("SALTS", 3)):
        monkeypatch.setattr(lines, name, value)
        assert {r.doc_id: r.text for r in lines.clean_lines(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("sites", [9, 10, 11, 400])
def test_lines_near_the_threshold_are_exact(spark, sites):
    docs = frame(spark, [(i, "shared line of text", f"site{i % sites}") for i in range(max(24, sites))])
    gone = lines.removals(docs).count()
    assert gone == (max(24, sites) - 1 if sites >= 10 else 0)


def brute_hits(text, items, size=10):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower()) if t else []
    w, hit, found = split(text), set(), set()
    for item, t in items:
        b = split(t)
        n = min(size, len(b))
        for s in range(max(1, len(b) - size + 1)) if b else []:
            for i in range(len(w) - n + 1):
                if w[i : i + n] == b[s : s + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), sorted(found)


def test_shards_hold_bounded_bytes():
    import pyarrow as pa

    from lectern.llm.common import shards

    texts = ["a" * n for n in (1, 5, 400, 3, 0, 90, 90, 20)] + [None]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i : i + 4], pa.string()), "n": list(range(i, min(i + 4, 9)))}) for i in (0, 4, 8)]
    got = list(shards(iter(batches), "text", 100))
    assert [n for b in got for n in b.column("n").to_pylist()] == list(range(9))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column("text").to_pylist()) <= 100 for b in got)
    assert list(shards(iter([]), "text", 100)) == []


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination_matches_brute_force(spark, block_bytes):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([30, 25, 12, 10, 3, 1, 40])] + [(7, ""), (8, None), (None, "alpha1 beta2"), (11, " ".join(words(rng, 14))), (10, "Über-Straße x9")]
    texts = [None, "", items[0][1], "pre " + items[1][1].upper() + ", post", items[2][1][:-1], " ".join(items[0][1].split()[5:17]) + " mid " + items[3][1], "x über straße X9 y", items[0][1] + " " + items[0][1], items[11][1] if len(items) > 11 and items[11][1] else "", " ".join(words(rng, 3000))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, contaminated int")
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(2, texts[2], "s")])
    got = decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()
    real = [(i, t) for i, t in items if i is not None]
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items) == brute_hits(texts[r.doc_id], real), r
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in got if not r.contaminated)
    longest = {(r.doc_id, r.item_id): (r.doc_word, r.item_word, r.n_words) for r in decontaminate.longest_matches(docs, bench, block_bytes=block_bytes).where("item_id <= 3").collect()}
    assert longest[(3, 1)] == (1, 0, 25) and longest[(5, 0)] == (0, 5, 12)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(3)
    words_ = np.append(rng.integers(1, 4, 300), np.zeros(10, np.int64))
    order = decontaminate.suffix_array(words_, 10)
    keys = [tuple(words_[i : i + 10]) for i in order if i < 300]
    assert keys == sorted(keys)


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(300)]
    rows[17] = (17, rows[16][1])
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (500, [0.0] * 6), (600, [1.0, 2.0]), (301, rows[3][1]), (301, rows[3][1])]
    vectors = topk.scaled(spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int"))
    for block_bytes in (1 << 20, 1500):
        got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10, block_bytes).collect()
        ok = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
        want = defaultdict(list)
        for q, x in ok:
            if q % 100 == 0:
                best = sorted((-int(x @ y), i) for i, y in ok if i != q and len(x) == len(y))[:10]
                want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
        have = defaultdict(list)
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            have[r.query_id].append((r.rank, r.vec_id, r.score))
        assert dict(have) == {k: v for k, v in want.items() if v}
    none = vectors.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_top_k_of_repeated_queries_and_huge_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3e38, 1.0]), (2, [0.0, 5.0]), (3, [-3e38, 2.0]), (100, [3e38, 3e38])]
    vectors = topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    most = (1 << 63) - 1
    # of query 0 the vector (0, 1) sorts first
    assert got[0] == [(100, most), (2, 5 * 1024 * 1024), (3, 2 * 1024 * 1024)]
    assert got[100] == [(0, most), (0, most), (1, most)]


def test_the_bound_stops_the_search():
    rng = np.random.default_rng(1)
    weights = np.array([1.0, 0.02, 0.02, 0.02])
    vectors = np.floor(1024 * rng.normal(0, 1, (4000, 4)) * weights)
    shard, none = topk.Shard(np.arange(4000), vectors), (np.zeros(0, np.int64), np.zeros(0, np.int64))
    scores, ids = shard.search(-1, np.array([900.0, 10.0, -10.0, 0.0]), 10, none)
    exact = vectors @ np.array([900.0, 10.0, -10.0, 0.0])
    order = np.lexsort((np.arange(4000), -exact))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == exact[order].astype(int).tolist()
    assert shard.scored < 1500
