"""Language by nearest centroid: TF-IDF vectors of hashed byte n-grams against several clustered centroids a language.

Defined results
* null text, or text without a letter: `und`, score 0; likewise when no language could be learned;
* any other text gets the language of the centroid with the greatest cosine; ties go to the language that sorts first;
* `rejected` says that the cosine lies below the language's own training distances (a quantile); lang_pred stays;
* learning uses rows that are not held out, with a non-null lang and doc_id, and knows every lang among them; every row is
  predicted, repeated rows alike;
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import SEGMENT_BYTES, _LOWER, held_out, segments, utf8_parts

DIM = 4096
SIZES = (1, 2, 3)
#: The classifier is fitted on about so many rows a language (each row of a language has the same chance, by its hash), fewer
#: if all languages together would pass MAX_ROWS, but LEAST_ROWS of each at least. Only their sparse counts come to the driver,
#: 24 KB a row at most, however long the text; as a matrix MAX_ROWS of them take 105 MB.
ROWS_PER_LANGUAGE, MAX_ROWS, LEAST_ROWS = 400, 6400, 8
CLUSTERS, ROUNDS, REJECT_QUANTILE = 3, 10, 0.005

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


def ngram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x DIM counts of letter n-grams; all other bytes read as one blank. Long rows are taken block by block; a block
    also reads the bytes behind it that its last n-grams need, so blocks change nothing."""
    n = len(offsets) - 1
    out = np.zeros((n, DIM), np.float32)
    fold = np.where(_LETTER[_LOWER], _LOWER, 32).astype(np.uint8)
    for first, end in segments(offsets, SEGMENT_BYTES // 2):
        for begin in range(int(offsets[first]), int(offsets[end]), SEGMENT_BYTES):
            stop = min(begin + SEGMENT_BYTES, int(offsets[end]))
            beyond = min(stop + max(SIZES) - 1, int(offsets[end]))
            wide = fold[data[begin:beyond]].astype(np.uint32)
            rows = np.repeat(np.arange(end - first), np.diff(np.clip(offsets[first : end + 1], begin, beyond)))
            for size in SIZES:
                upto = min(stop - begin + size - 1, len(wide))
                block, row = wide[:upto], rows[:upto]
                if len(block) < size:
                    continue
                code = np.zeros(len(block) - size + 1, np.uint32)
                for j in range(size):
                    code = code * np.uint32(257) + block[j : len(block) - size + 1 + j]
                slot = ((code * np.uint32(2654435761)) >> np.uint32(20)) & np.uint32(DIM - 1)
                inside = row[: len(code)] == row[size - 1 :]
                flat = row[: len(code)][inside] * DIM + slot[inside]
                out[first:end] += np.bincount(flat, minlength=(end - first) * DIM).reshape(end - first, DIM)
    return out


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        fresh = [x[near == j].sum(axis=0) if (near == j).any() else c for j, c in enumerate(centres)]
        centres = np.stack([c / max(float(np.linalg.norm(c)), 1e-12) for c in fresh])
    return centres


class Model:
    """Languages of the centroid rows, the centroids, idf and the rejection cosines."""

    def __init__(self, langs: list[str], vectors: np.ndarray):
        present = (vectors > 0).sum(axis=0)
        self.idf = np.log((1 + len(vectors)) / (1 + present)).astype(np.float32) + 1
        x = _weighted(vectors, self.idf)
        names = np.array(langs)
        self.langs, centres = [], []
        for lang in sorted(set(langs)):
            c = cluster(x[names == lang], CLUSTERS)
            self.langs += [lang] * len(c)
            centres.append(c)
        self.centres = np.concatenate(centres).astype(np.float32)
        best = (x @ self.centres.T).max(axis=1)
        self.reject = {lang: float(np.quantile(best[names == lang], REJECT_QUANTILE)) for lang in set(langs)}

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = _weighted(counts, self.idf) @ self.centres.T
        at = cos.argmax(axis=1)
        return at, np.clip(cos[np.arange(len(at)), at], 0, 1)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """Learn from rows that are not held out; None if there is nothing to learn from."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    known = known.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()
    if not found:
        return None
    rows_each = min(rows_per_language, max(LEAST_ROWS, MAX_ROWS // len(found)))
    # a language's least draw always counts, so none goes without a row
    below = [(r["lang"], max(int(min(1.0, rows_each / r["n"]) * (1 << 20)), r["least"] + 1)) for r in found]
    drawn = known.join(F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below long")), "lang").where("draw < below")

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            counts = ngram_counts(*utf8_parts(batch.column("text")))
            slots = [np.flatnonzero(c) for c in counts]
            cols = [pa.array([x.astype("<u2").tobytes() for x in slots], pa.binary()), pa.array([c[x].astype("<f4").tobytes() for c, x in zip(counts, slots)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), *cols], ["lang", "slots", "counts"])

    rows = sorted((r["lang"], bytes(r["slots"]), bytes(r["counts"])) for r in drawn.select("lang", "text").mapInArrow(vectors, "lang string, slots binary, counts binary").collect())
    if not rows:
        return None
    dense = np.zeros((len(rows), DIM), np.float32)
    for i, (_, slots, counts) in enumerate(rows):
        dense[i, np.frombuffer(slots, "<u2")] = np.frombuffer(counts, "<f4")
    return Model([r[0] for r in rows], dense)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score, rejected."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        known = shared.value
        for batch in batches:
            n, letters = batch.num_rows, batch.column("letters").to_pylist()
            langs, scores, rejected = ["und"] * n, np.zeros(n), [False] * n
            if known is not None and n:
                data, offsets = utf8_parts(batch.column("text"))
                for first in range(0, n, 512):
                    part = offsets[first : first + 513]
                    at, cos = known.predict(ngram_counts(data[part[0] : part[-1]], part - part[0]))
                    for i, (a, c) in enumerate(zip(at.tolist(), cos.tolist()), first):
                        if letters[i]:
                            langs[i], scores[i], rejected[i] = known.langs[a], c, c < known.reject[known.langs[a]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return base.mapInArrow(run, SCHEMA)
