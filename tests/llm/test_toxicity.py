"""Positive-unlabelled toxicity: the risk and its slopes by hand, features by brute force, held-out accuracy, awkward inputs."""

import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import toxicity as T
from lectern.llm.common import table

SF = "/root/testdata/sf0.01"


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


def plain_grams(text):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) + b" " for w in words]
    return Counter(w[:n] for w in low for n in T.LENGTHS if len(w) >= n), len(words)


def test_grams_are_those_of_plain_python():
    texts = ["", "the idiot, IDIOTS!", "über-Größe a bc def ghij", "x" * 20 + " end", "end", "no-sep", "\n\n"]
    data, offsets = packed(texts)
    rows, sizes, begun = T._begun(data, offsets)
    got = [Counter() for _ in texts]
    for which, gram in T._grams(sizes, begun):
        for r, g in zip(rows[which], gram):
            got[r][int(g).to_bytes(8, "little").rstrip(b"\0")] += 1
    assert got == [plain_grams(t)[0] for t in texts]
    assert np.bincount(rows, minlength=len(texts)).tolist() == [plain_grams(t)[1] for t in texts]


def test_scores_are_those_of_plain_python():
    grams = [b"idiot ", b"idio", b"scum ", "réeux".encode()]
    codes = np.array([int.from_bytes(g, "little") for g in grams], np.uint64)
    weight = np.array([1.0, 0.5, 2.0, -1.0])
    model = T.Model(codes, weight, -1.0)
    texts = ["", "Idiot idiots scum", "réeuxpa " * 3 + "scum", "nothing here " * 3000 + "scum"]
    for text, got in zip(texts, model.scores(*packed(texts))):
        found, n = plain_grams(text)
        z = -1.0 + sum(w * found[g] * 100 / (n + T.SMOOTHING) for g, w in zip(grams, weight))
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_slopes_follow_the_risk_and_turn_round_below_zero():
    rng, prior, turned = np.random.default_rng(3), 0.2, set()
    for shift in (-3.0, 0.0, 3.0):
        z_p, z_u = rng.normal(shift, 1, 5), rng.normal(-2, 1, 9)
        sign = 1.0 if T.risk(z_p, z_u, prior)[1] >= 0 else -1.0
        turned.add(sign)
        aim = lambda: sum(T.risk(z_p, z_u, prior)) if sign > 0 else -T.risk(z_p, z_u, prior)[1]
        for z, slope in zip((z_p, z_u), T.slopes(z_p, z_u, prior)):
            for i in range(len(z)):
                z[i] += 1e-5
                up = aim()
                z[i] -= 2e-5
                assert abs((up - aim()) / 2e-5 - slope[i]) < 1e-6
                z[i] += 1e-5
    assert turned == {1.0, -1.0}


def test_training_finds_the_positives_among_unlabelled_rows():
    """Feature 0 marks positives, feature 1 is in all rows; a fifth of the unlabelled rows are positives."""
    n_p, n_u = 60, 300
    hidden = np.arange(n_u) % 5 == 0
    make = lambda first, n: T.Rows(np.concatenate([np.flatnonzero(first), np.arange(n)]), np.concatenate([np.zeros(first.sum(), int), np.ones(n, int)]), np.ones(first.sum() + n), n, 2)
    pos, unl = make(np.ones(n_p, bool), n_p), make(hidden, n_u)
    weight, bias = T.train(pos, unl, 0.2)
    assert (pos.scores(weight, bias) > 0).all() and ((unl.scores(weight, bias) > 0) == hidden).all()


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    return docs, labels, T.fit(docs, labels)


def test_held_out_rows(spark, fitted):
    docs, labels, model = fitted
    out = T.score(docs, model)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    got = out.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.toxic).mean() > 0.93 and (got.predicted[got.toxic == 0] == 0).mean() > 0.97


def test_planted_toxic_texts_are_caught_and_clean_ones_left(spark, fitted):
    docs, _, model = fitted
    clean = [r.text for r in docs.where("lang = 'en' and length(text) between 500 and 3000").orderBy("doc_id").limit(400).collect()]
    insults = ["idiot", "stupid", "moron", "scum", "trash", "worthless", "pathetic"]
    clean = [t for t in clean if not any(w in t for w in insults + ["loser", "clown", "disgusting"])][:100]

    def spoilt(text, k):
        words = text.split(" ")
        for i in range(3, len(words), 30):
            words[i] = insults[(i + k) % len(insults)]
        return " ".join(words)

    rows = [(i, t) for i, t in enumerate(clean)] + [(1000 + i, spoilt(t, i)) for i, t in enumerate(clean)]
    got = {r.doc_id: r.predicted for r in T.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert sum(got[i] for i in range(len(clean))) <= 1
    assert sum(got[1000 + i] for i in range(len(clean))) >= 0.95 * len(clean)


def test_labels_of_held_out_rows_are_not_read(spark, fitted):
    docs, labels, model = fitted
    turned = labels.withColumn("toxic", T.F.when(T.held_out(), 1 - T.F.col("toxic")).otherwise(T.F.col("toxic")))
    again = T.fit(docs.withColumn("source", T.F.lit("other")), turned)
    assert (again.weight == model.weight).all() and again.bias == model.bias and (again.lookup.grams == model.lookup.grams).all()


def test_awkward_rows(spark, fitted):
    _, _, model = fitted
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "x"), (5, "word " * 200_000 + "idiot"), (6, "ü" * 10), (4, "x"), (None, "some text"), (7, "w" * 3_000_000)]
    odd = spark.createDataFrame([(i, t, 0.5, True, "p") for i, t in rows], "doc_id long, text string, score double, held_out boolean, predicted string")
    got = T.score(odd, model).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert by_id[1][0].score == by_id[2][0].score == pytest.approx(1 / (1 + np.exp(-model.bias))) and by_id[4][0].score == by_id[4][1].score
    assert by_id[None][0].held_out and T.score(odd.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "idiot " * 9), (None, None)], "doc_id long, text string")
    for rows in ([], [(1, 0), (2, 0)], [(None, 1), (2, None)]):
        model = T.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert model is None and {(r.score, r.predicted) for r in T.score(docs, model).collect()} == {(0.0, 0)}
    none = T.fit(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert none is None
    few = T.fit(docs, spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in T.score(docs, few).collect())


def test_draws_stay_bounded_where_ids_and_rows_repeat(spark):
    same = [(1, "idiot here")] * 500 + [(1, f"idiot number {i}") for i in range(400)] + [(i, f"clean text {i}") for i in range(1000, 1200)]
    docs = spark.createDataFrame(same, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1001, 0), (1002, 0), (1003, 0)], "doc_id long, toxic int")
    drawn, sizes, _ = T._drawn(docs, labels, 50, 60)
    assert 20 < sizes[1] < 110 and 20 < sizes[0] <= 130 and drawn.count() == sum(sizes.values())
    model = T.fit(docs, labels, 50, 60)
    assert model is not None and T.score(docs, model).count() == len(same)
