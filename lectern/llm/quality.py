"""Quality of documents by a byte-level convolutional network in numpy.

The network reads a document as overlapping chunks, one every STRIDE bytes, from its first to its last byte. A chunk has two
channels: WIDTH bytes, and at LAGS places, STRIDE bytes apart, how far back the same four bytes stood last (in powers of two),
which shows repetition that single bytes can't. Each learned filter gives a response for every chunk; responses are max-pooled
over regions of POOL chunks. The mean and
the maximum of the pooled responses over all regions of the document are combined into one logit and one probability.

Defined results
* null and empty text: a document without chunks, scored by the network's bias alone;
* learning uses labelled rows that are not held out, with a non-null doc_id and quality; repeated labels of one document
  count once, by their mean, at 0.5 as good; of documents that share an id the text that sorts first is learned from; labels
  of one class only give a network that has seen that class alone;
* without any labelled row every score is 0.5, so every document is rejected by predict() and none by keep_good();
* every row is scored, repeated rows alike; an empty table gives an empty result; other columns are ignored by score()
  and kept by keep_good().
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import held_out, utf8_parts

WIDTH, STRIDE, LAGS, BUCKETS, POOL, FILTERS = 8, 4, 8, 16, 64, 16
THRESHOLD = 0.7
#: The network is fitted on about so many labelled rows of each class (drawn by the hash of doc_id) of at most TRAIN_BYTES
#: bytes each.
ROWS_PER_CLASS, TRAIN_BYTES = 1200, 1 << 15
STEPS, BATCH, RATE = 450, 32, 0.01
#: This share of the good training texts is cut to a random piece of CUT bytes, as short texts are rare and good.
CUT_SHARE, CUT = 0.3, (8, 160)
BLOCK_CHUNKS = 1 << 15
#: How far back repetition is seen, and the bytes of a block in which it is looked for (a multiple of STRIDE).
REACH, RECENCY_BLOCK = 1 << 16, 1 << 18


def recency(text: np.ndarray) -> np.ndarray:
    """For every STRIDE-th byte: 0 if its four bytes did not stand within REACH bytes before, else 1 + log2 of the distance to
    where they stood last. Long texts are taken in blocks, each with the REACH bytes before it."""
    out = np.zeros(-(-len(text) // STRIDE), np.uint8)
    for first in range(0, max(len(text) - 3, 0), RECENCY_BLOCK):
        begin, end = max(0, first - REACH), min(first + RECENCY_BLOCK, len(text) - 3)
        part = text[begin : end + 3]
        code = part[: end - begin].astype(np.uint32)
        for j in range(1, 4):
            code = (code << np.uint32(8)) | part[j : end - begin + j]
        order = np.argsort(code, kind="stable")
        same = code[order[1:]] == code[order[:-1]]
        back = np.zeros(end - begin, np.int64)
        back[order[1:]] = np.where(same, order[1:] - order[:-1], 0)
        back = back[first - begin :: STRIDE]
        back[back > REACH] = 0
        out[first // STRIDE : first // STRIDE + len(back)] = np.where(back > 0, np.minimum(1 + np.log2(np.maximum(back, 1)), BUCKETS - 1), 0)
    return out


class Network:
    """table[j, byte, f] and lags[j, bucket, f]: what a byte, or a recency, at place j of a chunk adds to filter f."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.08, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.lags = rng.normal(0, 0.08, (LAGS, BUCKETS, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.mean_weight = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.max_weight = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.shift, self.mean_weight, self.max_weight, self.bias, self.lags]

    def regions(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pooled responses (regions x filters), the number of each region's best chunk, and the recencies; chunks reach over
        the end into zeros, so every byte is read."""
        chunks = max(1, -(-(len(text) - WIDTH) // STRIDE) + 1) if len(text) else 0
        recent = np.append(recency(text), np.zeros(LAGS + 2, np.uint8))
        pooled, places = [], []
        for first in range(0, chunks, BLOCK_CHUNKS):
            n = min(BLOCK_CHUNKS, chunks - first)
            part = text[first * STRIDE : (first + n - 1) * STRIDE + WIDTH]
            part = np.append(part, np.zeros((n - 1) * STRIDE + WIDTH - len(part), np.uint8))
            total = np.take(self.table[0], part[: (n - 1) * STRIDE + 1 : STRIDE], axis=0)
            for j in range(1, WIDTH):
                total += np.take(self.table[j], part[j : j + (n - 1) * STRIDE + 1 : STRIDE], axis=0)
            for j in range(LAGS):
                row = recent[first + j : first + j + n]
                if len(row) < n:
                    row = np.append(row, np.zeros(n - len(row), np.uint8))
                total += np.take(self.lags[j], row, axis=0)
            rows = -(-n // POOL)
            if rows * POOL != n:
                total = np.concatenate([total, np.full((rows * POOL - n, FILTERS), -1e9, np.float32)])
            total = total.reshape(rows, POOL, FILTERS)
            best = total.argmax(axis=1)
            pooled.append(np.take_along_axis(total, best[:, None, :], axis=1)[:, 0, :])
            places.append(first + np.arange(rows)[:, None] * POOL + best)
        if not pooled:
            return np.zeros((0, FILTERS), np.float32), np.zeros((0, FILTERS), np.int64), recent
        return np.maximum(np.concatenate(pooled) + self.shift, 0), np.concatenate(places), recent

    def logit(self, text: np.ndarray) -> float:
        r, _, _ = self.regions(text)
        if not len(r):
            return float(self.bias[0])
        return float(r.mean(axis=0) @ self.mean_weight + r.max(axis=0) @ self.max_weight + self.bias[0])

    def gradients(self, text: np.ndarray, label: float, into: list[np.ndarray]) -> float:
        r, places, recent = self.regions(text)
        n = len(r)
        mean, top = (r.mean(axis=0), r.max(axis=0)) if n else (np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float32))
        z = float(mean @ self.mean_weight + top @ self.max_weight + self.bias[0])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        d = np.float32(p - label)
        into[2] += d * mean
        into[3] += d * top
        into[4] += d
        if n:
            g = np.broadcast_to(d * self.mean_weight / n, r.shape).copy()
            g[r.argmax(axis=0), np.arange(FILTERS)] += d * self.max_weight
            g *= r > 0
            into[1] += g.sum(axis=0)
            rows, cols = np.nonzero(g)
            padded = np.append(text, np.zeros(WIDTH, np.uint8))
            at, push = places[rows, cols], g[rows, cols]
            for j in range(WIDTH):
                np.add.at(into[0][j], (padded[at * STRIDE + j], cols), push)
            for j in range(LAGS):
                np.add.at(into[5][j], (recent[np.minimum(at + j, len(recent) - 1)], cols), push)
        return float(-np.log(max(p if label > 0.5 else 1 - p, 1e-9)))


def train(texts: list[bytes], labels: list[float], seed: int = 5) -> Network:
    """Adam over shuffled batches; classes weigh alike as their rows are drawn alike."""
    net, rng = Network(seed), np.random.default_rng(seed)
    data = [np.frombuffer(t, np.uint8) for t in texts]
    first, second, step = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    while step < STEPS:
        order = rng.permutation(len(data))
        for b in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in net.params()]
            rows = order[b : b + BATCH]
            for i in rows:
                text = data[i]
                if labels[i] > 0.5 and rng.random() < CUT_SHARE and len(text) > CUT[1]:
                    at = int(rng.integers(0, len(text) - CUT[1]))
                    text = text[at : at + int(rng.integers(*CUT))]
                net.gradients(text, labels[i], grads)
            step += 1
            rate = RATE * (1 - 0.8 * min(1, step / STEPS))
            for p, g, m, v in zip(net.params(), grads, first, second):
                g /= len(rows)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[Network | None, float]:
    """The network and the prior log-odds correction for drawing classes alike; (None, 0) without labels."""
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("q")).select("doc_id", (F.col("q") >= 0.5).alias("good"))
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    if not counts:
        return None, 0.0
    shares = {k: min(1.0, rows_per_class / n) for k, n in counts.items()}
    share = F.when(F.col("good"), shares.get(True, 0.0)).otherwise(shares.get(False, 0.0))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    short = docs.where(F.octet_length("text") <= TRAIN_BYTES).select("doc_id", "text")
    # the draw is bounded by rows_per_class, so it is sent to the documents and not they to it
    found = short.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["text"], r["good"]) for r in found.collect())
    if not rows:
        return None, 0.0
    net = train([r[1].encode() for r in rows], [float(r[2]) for r in rows])
    correction = float(np.log(shares[False] / shares[True])) if len(shares) == 2 else 0.0
    return net, correction


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _scores(batch, net: Network | None, correction: float) -> np.ndarray:
    n = batch.num_rows
    if net is None:
        return np.full(n, 0.5)
    data, offsets = utf8_parts(batch.column("text"))
    z = np.array([net.logit(data[offsets[i] : offsets[i + 1]]) for i in range(n)], np.float64) + correction
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: tuple[Network | None, float], threshold: float = THRESHOLD) -> DataFrame:
    """documents -> doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            s = _scores(batch, *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: tuple[Network | None, float], threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold, all columns kept; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            net, correction = shared.value
            yield batch if net is None else batch.filter(pa.array(_scores(batch, net, correction) >= threshold))

    return docs.mapInArrow(run, docs.schema)
