"""WARC round trips, the loser tree, packing, and the pipeline."""

import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import packing, warc
from lectern.llm.common import table
from lectern.llm.queries import QUERIES


def test_loser_tree_merges_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert [x for _, x in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark):
    big = "é" * 80
    rows = [(1, "http://b.example/x", big), (2, "http://a.example/", big), (3, None, None), (4, "https://www.a.example/p?q=1", "short"), (5, "u r\nl", "short"), (6, "x", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9), (1, "http://b.example/x", big), (None, "http://n/", big), (7, "y", "x" * 300_000)]
    pages = spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, digest string")
    got = warc.capture_history(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        by[i] = (len(raw), hashlib.sha256(raw).hexdigest())
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == by[r.page_id]
        assert (r.record_type, r.refers_to) == (("revisit", 1) if r.page_id == 2 else ("response", None))
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys)
    assert warc.capture_history(pages.limit(0)).count() == 0


def test_capture_times_are_utc_and_bounded(spark):
    rows = [(0, "http://a/", "x"), (10**15, "http://a/", "y"), (-5, "http://a/", "z"), ((1 << 63) - 1, "http://a/", "z"), (None, "http://a/", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    zone, seen = spark.conf.get("spark.sql.session.timeZone"), []
    try:
        for name in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            seen.append(sorted((str(r.page_id), r.captured) for r in warc.capture_history(pages).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert seen[0] == seen[1]
    from datetime import datetime, timezone

    for page, when in seen[0]:
        seconds = warc.EPOCH + (0 if page == "None" else int(page)) % warc.SPAN
        assert when == datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_many_digests_meet_by_salt(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(warc, "SALTS", 3)
    rows = [(i, f"http://h{i % 7}/{i}", "same" * 50 if i % 3 else f"own {i} " * 40) for i in range(90)] + [(4, "http://h4/4", "same" * 50), (None, "http://n/", "same" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.capture_history(pages).collect()]
    assert sorted(map(str, got)) == sorted(str((i, "revisit", 1) if i is not None and i % 3 and i != 1 else (i, "response", None)) for i, _, _ in rows)


def test_archives_hold_bounded_bytes(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h/{i:04d}", "x" * (500 if i % 5 else 20_000)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(pages, str(tmp_path / "w"), classes=((1000, 20), (1 << 62, 2)))
    files = [f for f in (tmp_path / "w").rglob("part-*")]
    assert len(files) >= 28 and max(f.stat().st_size for f in files) < 45_000
    merged = warc.merge_index(warc.read_archives(spark, str(tmp_path / "w")), 3).collect()
    assert [r.page_id for r in merged] == list(range(200))


def check_pack(lengths):
    seen = {d: [] for d in range(len(lengths))}
    for tier, seq in packing.pack(lengths):
        assert sum(n for _, _, n in seq) == tier and tier & (tier - 1) == 0 and tier <= 1024
        for d, s, n in seq:
            seen[d].append((s, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at and k > 0
            at += k
        assert at == n


@pytest.mark.parametrize("seed", range(5))
def test_packing_covers_each_token_once_without_padding(seed):
    rng = random.Random(seed)
    check_pack([rng.choice([1, 3, 60, 400, 1024, 1025, 5000]) + rng.randrange(300) for _ in range(rng.randrange(1, 200))])
    check_pack([])
    check_pack([1])


def test_step_groups_are_balanced(spark, sf):
    """All groups of a tier hold the same tokens, but for the last one of each task."""
    docs = table(spark, sf, "documents").repartition(2)
    got = packing.pack_documents(docs, window_tokens=5000, step_tokens=4096).toPandas()
    groups = got.groupby(["step_group", "tier"]).length.sum().reset_index()
    assert (groups.groupby("step_group").tier.count() == 1).all() and groups.length.max() == 4096
    task = groups.step_group // (1 << 40)
    short = groups[groups.length < 4096]
    assert (short.groupby([task[short.index], "tier"]).length.count() == 1).all()
    assert (groups.length == 4096).sum() > 20
    sums = got.groupby("sequence_id").length.sum()
    assert (sums == got.groupby("sequence_id").tier.first()).all()


def test_packed_ids_are_those_of_the_tokenizer(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hard = spark.createDataFrame([(10**6, None, 1), (10**6 + 1, "", 1), (10**6 + 2, "a <|endoftext|> b", 1), (10**6 + 3, "zz " * 30_000, 1), (None, "x", 1)], "doc_id long, text string, tier int")
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(1).alias("tier")).unionByName(hard)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = {}
    for r in packing.pack_documents(docs).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for d, rows in pieces.items():
        ids = np.append(np.array(tok.encode(texts[d] or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def plain_pipeline(rows, scores, benchmark):
    """The five decisions one after another in plain Python, on (doc_id, text, source) with given scores: what is left."""
    import re
    from collections import defaultdict

    rows = sorted((r for r in rows if scores[r[0]] >= 0.7), key=lambda r: r[0])
    places = defaultdict(list)
    for d, text, site in rows:
        for pos, line in enumerate((text or "").split("\n")):
            norm = re.sub(r"[ \t\n\x0b\f\r]+", " ", line).strip(" ").lower()
            if len(norm) >= 8:
                places[norm].append((d, pos, site))
    gone = {(d, pos) for found in places.values() if len({s for *_, s in found}) >= 10 for d, pos, _ in sorted(found)[1:]}
    rows = [(d, None if t is None else "\n".join(x for pos, x in enumerate(t.split("\n")) if (d, pos) not in gone), s) for d, t, s in rows]
    low = lambda t: (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    sets = {}
    for d, t, _ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    rows = [r for r in rows if group[r[0]] == r[0]]
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {tuple(w[i : i + 10]) for _, t in benchmark if (w := words(t)) for i in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    return {d: t for d, t, _ in rows if clean(words(t))}


def pipeline_fixture(spark, tmp_path):
    """Documents with boilerplate, copies, near copies, benchmark passages, nulls, empties, a very long text and extra columns."""
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("al", "be", "ga", "de", "ep", "ze", "eta", "th") for b in range(30)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    benchmark = [(i, prose(n)) for i, n in enumerate((25, 14, 10))] + [(9, ""), (10, None)]
    rows = [(i, f"{prose(40)}\nSubscribe to our newsletter\n{prose(30)}", f"site{i % 14}") for i in range(60)]
    base = prose(120).split()
    rows += [(100 + i, " ".join(base), f"site{i}") for i in range(5)]
    rows += [(110 + i, " ".join(base[:60] + [f"changed{i}"] + base[61:]), "site1") for i in range(4)]
    rows += [(120, prose(20) + " " + benchmark[0][1] + " " + prose(20), "s"), (121, prose(9) + "\n" + benchmark[2][1].upper(), "s"), (122, benchmark[1][1][:-8], "s")]
    rows += [(130, None, "s"), (131, "", "s"), (132, "  \n ", None), (133, prose(40_000), "s"), (134, "one two", "s"), (135, "one two", "t")]
    frame = spark.createDataFrame([(d, t, "en", s, len(t or ""), "k", 0.5, 7) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, bucket int")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(d, d % 2, 0) for d, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows, benchmark


def test_pipeline_matches_brute_force(spark, tmp_path, monkeypatch):
    from lectern.llm import quality

    rows, benchmark = pipeline_fixture(spark, tmp_path)
    scores = {d: 0.1 if d in (3, 17, 101, 134) else 0.9 for d, *_ in rows}
    # scores are given, so that the decisions can be followed by hand
    rejected = [d for d in scores if scores[d] < 0.7]
    monkeypatch.setattr(quality, "fit", lambda docs, labels: None)
    monkeypatch.setattr(quality, "keep_good", lambda docs, model: docs.where(~F.col("doc_id").isin(rejected)))
    want = plain_pipeline(rows, scores, benchmark)
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, r.ids_crc32))
    assert set(pieces) == set(want) and 0 < len(want) < len(rows)
    encode = packing.encoder()
    for d, text in want.items():
        ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
        at = 0
        for start, length, total, crc in sorted(pieces[d]):
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)


def test_pipeline_stages_agree_with_the_operators(spark, sf):
    docs = table(spark, sf, "documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    good = stages["quality classifier"](spark, docs, sf)
    assert ids(good) == ids(QUERIES["op2_quality_classifier"](spark, sf).where("predicted = 1"))
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert ids(stages["MinHash near-dedup"](spark, docs, sf)) == ids(QUERIES["op1_minhash_near_dedup"](spark, sf).where("kept"))
    assert ids(stages["benchmark decontamination"](spark, docs, sf)) == ids(QUERIES["op9_decontamination"](spark, sf).where("not contaminated"))
    got = corpus_pipeline.run(spark, sf).agg(F.countDistinct("doc_id"), F.sum("length")).first()
    assert 0 < got[0] < docs.count() and got[1] > 0
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.limit(0), sf) if "tier" not in docs.columns else docs
        assert docs.count() == 0
