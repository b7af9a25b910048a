"""Toxicity by non-negative positive-unlabelled learning: a linear classifier in numpy over beginnings of words.

Confirmed toxic documents are the positives; documents drawn without a look at their labels are the unlabelled rows, which hold
toxic ones too. With the class prior pi, the risk of a classifier z is

    pi * E_p[l(-z)] + max(0, E_u[l(z)] - pi * E_p[l(z)])        (l: the logistic loss)

The second term estimates the risk on negatives from unlabelled rows, less what the toxic ones among them add. It can't be
negative in truth, so where the estimate falls below zero the step turns round instead of going on.

A word is a run of ASCII letters, digits and bytes above 127, A-Z lower-cased. Its grams are the first LENGTHS bytes of the word
and the space behind it, so short words are grams whole. A document's value for a gram is how many of its words begin so, per
hundred words of the whole text. Grams are learned if they are commoner among positives than among unlabelled documents.

Defined results
* null and empty text, and text without a learned gram: the score of the bias alone;
* the labels of held-out rows are not read, nor are labels with a null doc_id or value; a document with several labels is
  toxic if one of them says so, and each text of a doc_id that repeats is a row of its own;
* without a toxic training row nothing is learned: every score is 0;
* every row is scored, repeated rows alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import _LOWER, ALNUM_WORDS, discard, materialize, segments, utf8_parts

THRESHOLD = 0.5
#: About so many documents of each kind are learned from, drawn by hashes of ids and rows, whatever their length.
POSITIVES, UNLABELLED = 2000, 4000
LENGTHS = (4, 5, 6, 7, 8)
#: Grams that the fit may weigh: in MIN_DOCUMENTS positives at least, with a log-likelihood ratio of APART or more, and of these
#: the FEATURES with the highest.
MIN_DOCUMENTS, APART, FEATURES = 3, 8.0, 4096
#: Words added to a document's length, so that one word of a very short text is no certain sign.
SMOOTHING = 8
STEPS, RATE, SHRINK = 400, 0.3, 1 / 300
#: Bounds of the class prior, which is the share of toxic rows among labelled training rows.
PRIOR = (0.005, 0.5)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels no model may learn from: crc32(doc_id as text) mod 5 is 0. A null id is held out as well."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _begun(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of the rows: its row, its size and its first eight bytes as a number, a space behind a shorter word."""
    low = _LOWER[data]
    inside = ALNUM_WORDS[low]
    first = np.zeros(len(low) + 1, bool)
    first[offsets[:-1]] = True
    before = np.append(False, inside[:-1]) if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.append(inside[1:], False) if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    padded = np.append(low, np.zeros(8, np.uint8))
    eight = np.ndarray((len(low) + 1,), "<u8", padded.tobytes(), strides=(1,))[starts]
    sizes = ends - starts
    short = np.minimum(sizes, 8).astype(np.uint64) * np.uint64(8)
    keep = np.where(sizes >= 8, ~np.uint64(0), (np.uint64(1) << short) - np.uint64(1))
    space = np.where(sizes >= 8, np.uint64(0), np.uint64(32) << np.minimum(short, np.uint64(56)))
    return rows, sizes, (eight & keep) | space


def _grams(sizes: np.ndarray, begun: np.ndarray):
    """(which words, gram) for each length; grams of different lengths differ in their last bytes."""
    for length in LENGTHS:
        which = np.flatnonzero(sizes + 1 >= length)
        yield which, begun[which] & np.uint64((1 << 8 * length) - 1)


def _document_grams(batches):
    """(row, toxic) -> a row per document and distinct gram."""
    import pyarrow as pa

    for batch in batches:
        data, offsets = utf8_parts(batch.column("text"))
        for one, end in segments(offsets):
            rows, sizes, begun = _begun(data[offsets[one] : offsets[end]], offsets[one : end + 1] - offsets[one])
            found_rows, found = zip(*[(rows[which], gram) for which, gram in _grams(sizes, begun)])
            found_rows, found = np.concatenate(found_rows), np.concatenate(found)
            order = np.lexsort((found, found_rows))
            found_rows, found = found_rows[order], found[order]
            new = np.ones(len(found), bool)
            new[1:] = (found_rows[1:] != found_rows[:-1]) | (found[1:] != found[:-1])
            toxic = batch.column("toxic").take(pa.array(found_rows[new] + one))
            yield pa.RecordBatch.from_arrays([toxic, pa.array(found[new].view(np.int64))], ["toxic", "gram"])


class Lookup:
    """Places of grams in a sorted list of learned ones; a bitmap turns most grams away."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams.astype(np.uint64))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.grams * _SPREAD) >> np.uint64(48)] = True

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature) for each learned gram that a word begins with, and each row's number of words."""
        rows, sizes, begun = _begun(data, offsets)
        out_rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for which, gram in _grams(sizes, begun):
            maybe = self.seen[(gram * _SPREAD) >> np.uint64(48)]
            which, gram = which[maybe], gram[maybe]
            at = np.minimum(np.searchsorted(self.grams, gram), max(len(self.grams) - 1, 0))
            hit = self.grams[at] == gram if len(self.grams) else np.zeros(0, bool)
            out_rows.append(rows[which[hit]])
            out.append(at[hit])
        return np.concatenate(out_rows), np.concatenate(out), np.bincount(rows, minlength=len(offsets) - 1)


def _values(rows: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What one word adds to its document's value: words of the kind per hundred."""
    return 100.0 / (n_words[rows] + SMOOTHING)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Documents as sparse rows: (row, feature, value) triples."""

    def __init__(self, rows: np.ndarray, features: np.ndarray, values: np.ndarray, n: int, d: int):
        self.rows, self.features, self.values, self.n, self.d = rows, features, values, n, d

    def scores(self, weight: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.rows, weight[self.features] * self.values, self.n) + bias

    def back(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.features, per_row[self.rows] * self.values, self.d)


def _loss(z: np.ndarray) -> np.ndarray:
    """Logistic loss of a row that should score high, by -z; of one that should score low, by z."""
    return np.logaddexp(0, z)


def risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part of the risk, and the estimate of its negative part before it is held at zero."""
    return prior * float(_loss(-z_p).mean()), float(_loss(z_u).mean()) - prior * float(_loss(z_p).mean())


def slopes(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """How the step's aim changes with each score: the whole risk, or where its negative part is below zero, that part's
    negative, as the step then leads back up."""
    s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
    if risk(z_p, z_u, prior)[1] >= 0:
        # s_p - 1 of the positive part and s_p of the negative one leave -1
        return np.full(len(z_p), -prior / len(z_p)), s_u / len(z_u)
    return prior * s_p / len(z_p), -s_u / len(z_u)


def train(positive: Rows, unlabelled: Rows, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk: steps along the averaged gradient, of a length that does not follow the
    gradient's size and falls to a tenth; weights shrink towards zero after each."""
    weight, bias = np.zeros(positive.d), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(positive.d + 1), 0.0
    for step in range(1, steps + 1):
        push_p, push_u = slopes(positive.scores(weight, bias), unlabelled.scores(weight, bias), prior)
        gradient = np.append(positive.back(push_p) + unlabelled.back(push_u), push_p.sum() + push_u.sum())
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (float(gradient @ gradient) - square)
        rate = RATE * (1 - 0.9 * step / steps)
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - float(move[-1])
        weight = np.sign(weight) * np.maximum(np.abs(weight) - rate * SHRINK, 0)
    return weight, bias


class Model:
    def __init__(self, grams: np.ndarray, weight: np.ndarray, bias: float):
        kept = weight != 0
        order = np.argsort(grams[kept].astype(np.uint64))
        self.lookup, self.weight, self.bias = Lookup(grams[kept]), weight[kept][order], bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        for one, end in segments(offsets):
            rows, features, n_words = self.lookup.features(data[offsets[one] : offsets[end]], offsets[one : end + 1] - offsets[one])
            z[one:end] += np.bincount(rows, self.weight[features] * _values(rows, n_words), end - one)
        return _sigmoid(z)


def _drawn(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, dict[int, int], float]:
    """text, toxic (1 confirmed, 0 drawn blindly) of the training rows, their numbers, and the class prior.

    Rows that repeat are drawn once, and where an id has so many texts that a draw is over twice its size it is thinned by row.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rows = docs.where(~held_out()).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    part = lambda key, seed, share: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)
    # at most about `positives` ids are sent to the documents
    confirmed = known.where((F.col("toxic") == 1) & part("doc_id", 1, min(1.0, positives / max(n_toxic, 1)))).select("doc_id")
    toxic = rows.join(F.broadcast(confirmed), "doc_id", "left_semi").dropDuplicates(["doc_id", "row"]).select("row", "text", F.lit(1).alias("toxic"))
    blind = rows.where(part("row", 2, min(1.0, unlabelled / max(rows.count(), 1)))).dropDuplicates(["doc_id", "row"]).select("row", "text", F.lit(0).alias("toxic"))
    drawn = materialize(toxic.unionByName(blind), "toxicity-draw")
    sizes = {r["toxic"]: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    wide = {kind: most / sizes[kind] for kind, most in ((1, positives), (0, unlabelled)) if sizes.get(kind, 0) > 2 * most}
    if wide:
        kept = F.lit(True)
        for kind, share in wide.items():
            kept = kept & ((F.col("toxic") != kind) | part("row", 3, share))
        thin = materialize(drawn.where(kept), "toxicity-draw")
        discard(drawn)
        drawn, sizes = thin, {r["toxic"]: r["count"] for r in thin.groupBy("toxic").count().collect()}
    return drawn, sizes, float(np.clip(n_toxic / max(n, 1), *PRIOR))


def _vectors(drawn: DataFrame, lookup: Lookup) -> tuple[Rows, Rows]:
    """Sparse rows of the positives and of the unlabelled; as many values as a draw's documents have learned grams."""
    shared = drawn.sparkSession.sparkContext.broadcast(lookup)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8_parts(batch.column("text"))
            rows, features, n_words = shared.value.features(data, offsets)
            key, count = np.unique(rows * FEATURES + features, return_counts=True)
            value, cuts = count * _values(key // FEATURES, n_words), np.searchsorted(key // FEATURES, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in ((key % FEATURES).astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *lists], ["toxic", "features", "values"])

    found = drawn.select("toxic", "text").mapInArrow(run, "toxic int, features array<int>, values array<double>").collect()
    out = []
    for kind in (1, 0):
        of_kind = sorted((r["features"], r["values"]) for r in found if r["toxic"] == kind)
        row = np.repeat(np.arange(len(of_kind)), [len(f) for f, _ in of_kind])
        flat = lambda k, t: np.array([x for r in of_kind for x in r[k]], t)
        out.append(Rows(row, flat(0, np.int64), flat(1, np.float64), len(of_kind), len(lookup.grams)))
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """A model of the toxic rows of `labels` and of documents drawn without labels; None without a toxic training row."""
    drawn, sizes, prior = _drawn(docs, labels, positives, unlabelled)
    n_p, n_u = sizes.get(1, 0), max(sizes.get(0, 0), 1)
    if not n_p:
        discard(drawn)
        return None
    seen = drawn.mapInArrow(_document_grams, "toxic int, gram long").groupBy("gram").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u"))
    apart = F.col("p") * F.log((F.col("p") + 0.5) / n_p * (n_u + 1) / (F.col("u") + 0.5))
    best = seen.where((F.col("p") >= MIN_DOCUMENTS) & (apart >= APART)).select("gram", apart.alias("apart")).orderBy(F.desc("apart"), "gram").limit(FEATURES)
    grams = np.array([r["gram"] for r in best.collect()], np.int64).view(np.uint64)
    lookup = Lookup(grams)
    weight, bias = train(*_vectors(drawn, lookup), prior)
    discard(drawn)
    return Model(lookup.grams, weight, bias)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """documents -> doc_id, held_out, score, predicted; one pass over whole texts, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = shared.value.scores(*utf8_parts(batch.column("text"))) if shared.value is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)
