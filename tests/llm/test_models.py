"""Quality, language, personal data and licences: held-out accuracy, exact parts against brute force, awkward inputs."""

import re

import duckdb
import numpy as np
import pytest

from lectern.llm import langid, licences, pii, quality
from lectern.llm.common import table

SF = "/root/testdata/sf0.01"


def awkward(spark):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "x"), (5, "word " * 200_000), (6, "ü" * 10), (4, "x"), (None, "some text")]
    return spark.createDataFrame([(i, t, "en", "s", 1.0, "p") for i, t in rows], "doc_id long, text string, lang string, source string, score double, predicted string")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_quality_on_held_out_rows(spark, docs):
    labels = table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).join(labels.groupBy("doc_id").agg({"quality": "max"}).withColumnRenamed("max(quality)", "quality"), "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and ((got.predicted == got.quality).mean()) > 0.9
    hard = quality.score(awkward(spark), model).collect()
    assert len(hard) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in hard)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(awkward(spark), none)
    assert {r.score for r in quality.score(awkward(spark), model).collect()} == {0.5}
    assert quality.keep_good(awkward(spark), model).count() == 8


def test_network_reads_every_byte_and_its_gradient_is_right():
    net, rng = quality.Network(), np.random.default_rng(0)
    text = rng.integers(0, 255, 1001).astype(np.uint8)
    grads = [np.zeros_like(p, dtype=np.float64) for p in net.params()]
    net.gradients(text, 1.0, grads)
    at = np.unravel_index(np.abs(grads[0]).argmax(), grads[0].shape)
    loss = lambda: np.log1p(np.exp(-net.logit(text)))
    net.table[at] += 1e-2
    up = loss()
    net.table[at] -= 2e-2
    down = loss()
    assert abs((up - down) / 2e-2 - grads[0][at]) < 0.05 * abs(grads[0][at]) + 1e-4
    _, places, recent = net.regions(text)
    assert places.max() * quality.STRIDE + quality.WIDTH >= 1001 - quality.POOL * quality.STRIDE
    back = quality.recency(np.frombuffer(b"Ingerou Ingerou Ingerou xyzw", np.uint8))
    assert back.tolist() == [0, 0, 4, 4, 4, 4, 0]
    tail = text.copy()
    net.table[:, 255, :] = 50.0
    tail[-1] = 255
    assert net.logit(tail) != net.logit(text)


def plain_logit(net, text):
    """The network chunk by chunk: filters, shift and rectifier, the maximum of each region, then mean and maximum."""
    recent = [0] * (-(-len(text) // quality.STRIDE))
    for k in range(len(recent)):
        i = k * quality.STRIDE
        if i + 4 <= len(text):
            before = [j for j in range(max(0, i - quality.REACH), i) if text[j : j + 4] == text[i : i + 4]]
            recent[k] = min(int(1 + np.log2(i - before[-1])), quality.BUCKETS - 1) if before else 0
    chunks = max(1, -(-(len(text) - quality.WIDTH) // quality.STRIDE) + 1) if text else 0
    responses = []
    for c in range(chunks):
        total = np.zeros(quality.FILTERS)
        for j in range(quality.WIDTH):
            at = c * quality.STRIDE + j
            total += net.table[j, text[at] if at < len(text) else 0]
        for j in range(quality.LAGS):
            total += net.lags[j, recent[c + j] if c + j < len(recent) else 0]
        responses.append(total)
    if not responses:
        return float(net.bias[0])
    pooled = [np.maximum(np.max(responses[i : i + quality.POOL], axis=0) + net.shift, 0) for i in range(0, chunks, quality.POOL)]
    return float(np.mean(pooled, axis=0) @ net.mean_weight + np.max(pooled, axis=0) @ net.max_weight + net.bias[0])


def test_network_matches_a_plain_convolution(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHUNKS", 128)
    monkeypatch.setattr(quality, "RECENCY_BLOCK", 64)
    monkeypatch.setattr(quality, "REACH", 200)
    net, rng = quality.Network(3), np.random.default_rng(2)
    net.shift += rng.normal(0, 0.1, quality.FILTERS).astype(np.float32)
    net.bias += np.float32(0.3)
    texts = [b"", b"a", b"abc", b"abcd", b"12345678", b"123456789", b"word " * 300, "übermäßig ".encode() * 40, bytes(rng.integers(0, 256, 3000).astype(np.uint8)), b"ab" * 700 + b"xyz"]
    for text in texts:
        assert abs(net.logit(np.frombuffer(text, np.uint8)) - plain_logit(net, text)) < 1e-3, text[:20]


def test_language_on_held_out_rows(spark, docs):
    model = langid.fit(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    hard = {(r.doc_id, r.lang_pred, r.score == 0) for r in langid.identify(awkward(spark), model).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True)} <= hard
    assert all(lang in ("en", "fr", "de", "es", "und") for _, lang, _ in hard)
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(awkward(spark), langid.fit(docs.limit(0))).collect()} == {"und"}


def test_ngrams_of_long_rows_equal_those_of_short_blocks(monkeypatch):
    data = np.frombuffer(b"some words of a text " * 4000, np.uint8)
    whole = langid.ngram_counts(data, np.array([0, 50, 50, len(data)]))
    monkeypatch.setattr(langid, "SEGMENT_BYTES", 4096)
    parts = langid.ngram_counts(data, np.array([0, 50, 50, len(data)]))
    assert whole[1].sum() == 0 and (whole == parts).all()


def test_tfidf_and_cosine_match_brute_force():
    """Counts, weights and the nearest centroid, one n-gram after another in plain Python."""
    import math
    from collections import Counter

    texts = ["Der Hund läuft.", "le chien court vite", "x1y", "the dog runs, the dog sleeps", ""]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw]))
    counts = langid.ngram_counts(np.frombuffer(b"".join(raw), np.uint8), offsets)
    brute = []
    for r in raw:
        folded = bytes(c + 32 if 65 <= c <= 90 else c for c in r)
        folded = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in folded)
        c = Counter()
        for size in langid.SIZES:
            for i in range(len(folded) - size + 1):
                code = 0
                for b in folded[i : i + size]:
                    code = (code * 257 + b) % (1 << 32)
                c[((code * 2654435761) % (1 << 32) >> 20) & (langid.DIM - 1)] += 1
        brute.append(c)
    assert all({int(k): int(row[k]) for k in np.flatnonzero(row)} == dict(c) for row, c in zip(counts, brute))
    model = langid.Model(["de", "fr", "xx", "en"], counts[:4])
    idf = [math.log(5 / (1 + sum(c[k] > 0 for c in brute[:4]))) + 1 for k in range(langid.DIM)]

    def unit(c):
        x = {k: math.log1p(n) * idf[k] for k, n in c.items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        return {k: v / norm for k, v in x.items()}

    at, cos = model.predict(counts)
    for i, c in enumerate(brute[:4]):
        best = max(sum(v * unit(o).get(k, 0) for k, v in unit(c).items()) for o in brute[:4])
        assert abs(best - cos[i]) < 1e-4 and model.langs[at[i]] == ["de", "fr", "xx", "en"][i]
    assert cos[4] == 0


def brute_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return out


HARD = ["a@b.c", "x..y@d-e.f.g. z", "@a.b a@@b.c a@b.c@d.e", "p@q r@s.t.u@v.w", "1.2.3.4.5.6.7.8", "300.1.1.1 255.255.255.255 001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "+1 (017) 555-7713 x +12 +1234567 +12345678", "++1 2 3 4 5 6 7 8 9", "é+33 1 23 45 67 89é a@b.c", "4539148803436467 4539148803436467", "a@b.c.d-", ""]


def test_pattern_spans_match_brute_force(docs):
    texts = HARD + [r.text for r in docs.select("text").collect()]
    assert [pii.base_spans(t) for t in texts] == [brute_spans(t) for t in texts]


def test_long_words_take_linear_time():
    for piece in ("a" * 300_000 + " a@b", "1" * 300_000, "1." * 150_000, "a." * 100_000 + "@", "+1" + "(" * 200_000):
        pii.all_spans([piece], pii.fit_field(pii.Nodes()))


def test_field_carries_labels_over_distant_mentions(spark, docs):
    field = pii.fit(docs)
    text = "call +1 (017) 555-7713 now " + "filler " * 300 + "or 017 555-7713 again, order 1234567 and 12.5"
    base, every = pii.all_spans([text], field)
    added = [text[a:b] for k, a, b in every[0] if (k, a, b) not in base[0]]
    assert added == ["017 555-7713"]
    alone = pii.all_spans(["see 017 555-7713 and 2669109448945251"], field)
    assert alone[0] == alone[1] == [[]]
    got = pii.find_personal_data(awkward(spark), field).collect()
    assert len(got) == 8 and all(r.spans == "" for r in got)
    assert pii.find_personal_data(docs.limit(0), field).count() == 0


def graph(rng, n, edges):
    nodes = pii.Nodes()
    for _ in range(n):
        nodes.spans.append((0, 1))
        nodes.doc.append(0)
        nodes.observed.append(rng.choice([0, 0, 1, 3]))
        nodes.truth.append(0)
        nodes.features.append([rng.randrange(pii.FEATURES) for _ in range(8)])
    nodes.edges = edges
    return nodes


def exact_marginals(field, nodes):
    """Every labelling of a small graph, weighed by its potentials."""
    from itertools import product

    n, local = len(nodes.spans), field.unary[np.array(nodes.features)].sum(axis=1)
    for i, o in enumerate(nodes.observed):
        local[i, o] += 25.0 if o else 0.0
    out = np.zeros((n, pii.LABELS))
    for labels in product(range(pii.LABELS), repeat=n):
        w = np.exp(sum(local[i, y] for i, y in enumerate(labels)) - local.max(axis=1).sum() + sum(field.agree[k] for a, b, k in nodes.edges if labels[a] == labels[b]))
        for i, y in enumerate(labels):
            out[i, y] += w
    return out / out.sum(axis=1, keepdims=True)


def test_messages_give_exact_marginals():
    import random

    rng, noise = random.Random(3), np.random.default_rng(3)
    for _ in range(20):
        field = pii.Field(noise.normal(0, 0.3, (pii.FEATURES, pii.LABELS)), np.abs(noise.normal(0, 1.5, 3)))
        tree = graph(rng, 6, [(rng.randrange(i), i, rng.randrange(3)) for i in range(1, 6)])
        assert np.abs(field.marginals(tree) - exact_marginals(field, tree)).max() < 1e-3
        loop = graph(rng, 5, [(0, 1, 0), (1, 2, 0), (2, 3, 0), (3, 4, 0), (0, 4, 1), (1, 3, 2)])
        assert np.abs(field.marginals(loop) - exact_marginals(field, loop)).max() < 0.15
    assert field.marginals(graph(rng, 3, [])).shape == (3, pii.LABELS)


def test_a_label_travels_along_a_long_chain():
    field = pii.Field(np.zeros((pii.FEATURES, pii.LABELS)), np.array([6.0, 6.0, 6.0]))
    nodes = graph(__import__("random").Random(1), 60, [(i, i + 1, 0) for i in range(59)])
    nodes.observed = [1] + [0] * 59
    assert (field.marginals(nodes).argmax(axis=1) == 1).all()


def test_masked_mentions_are_found_again(spark, docs):
    """Held-out documents, each with a masked repetition of one of its own spans far away, and one of a stranger's."""
    import random

    from lectern.llm.common import held_out

    docs = table(spark, "/root/testdata/sf0.1", "documents")
    field, rng = pii.fit(docs.where(~held_out())), random.Random(5)
    found = wrong = total = strangers = 0
    for r in docs.where(held_out()).select("text").collect():
        base = pii.base_spans(r.text or "")
        for k, a, b in base:
            form = pii.masked_form(k, r.text[a:b], rng.random())
            if not form:
                continue
            text = r.text + " tail " + "words " * 200 + form
            own, every = pii.all_spans([text], field)
            total += 1
            found += (k, len(text) - len(form), len(text)) in every[0]
            other = "".join(str(rng.randrange(10)) for _ in range(10))
            text = r.text + " tail " + "words " * 200 + other
            strangers += 1
            wrong += any(x[1] >= len(r.text) for x in set(pii.all_spans([text], field)[1][0]) - set(own[0]))
    assert total > 60 and found / total >= 0.9, (found, total)
    assert wrong / strangers <= 0.05, (wrong, strangers)


def test_licences(spark, docs):
    model = licences.fit(docs)
    got = {r.doc_id: r for r in licences.scan(docs, model).collect()}
    con = duckdb.connect()
    for family, words in (("apache", "Apache License"), ("gpl", "GNU General Public"), ("mit", "MIT License"), ("cc-by-nc", "CC BY-NC 4.0")):
        want = {r[0] for r in con.sql(f"select doc_id from '{SF}/documents.parquet' where text like '%{words}%'").fetchall()}
        assert {i for i, r in got.items() if family in r.families.split(",")} == want
    assert len(got) == docs.count()
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (1, "Licensed under the Apache License, Version 2.0."), (2, None), (3, ""), (4, "Licensed under the Wobble Source License."), (5, "nothing of the kind\nReleased under the MIT License."), (None, "Licensed under CC BY-NC 4.0.")]
    found = licences.scan(spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, gram string, pos int"), model).collect()
    have = sorted((str(r.doc_id), r.families, r.n_notices) for r in found)
    assert have == [("1", "apache", 1), ("1", "apache", 1), ("2", "", 0), ("3", "", 0), ("4", "", 0), ("5", "mit", 1), ("None", "cc-by-nc", 1)]
    assert next(r for r in found if r.doc_id == 4).n_unknown == 1
    assert licences.scan(docs.limit(0), model).count() == 0
