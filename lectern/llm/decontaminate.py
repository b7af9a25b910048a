"""Benchmark passages in training documents, found with suffix arrays over the documents' words.

Each shard of documents (SHARD_BYTES of text) gets a suffix array over its words; every suffix of every benchmark item is
binary-searched in it, which gives all verbatim occurrences, their locations and, merged along a diagonal, the longest
matches. A benchmark of up to BROADCAST_BYTES is sent to the tasks and judged in one pass. A larger one is worked off in
blocks, one pass each: a block's hits are written before the next block is sent, and documents get the union of their hits.

Defined results
* words are runs of 0-9, a-z (A-Z lowered) and non-ASCII characters; null text has none: n_words 0, not contaminated;
* an item of fewer than `window` words is one window; an item with a null id or without words takes no part;
* repeated items or rows count as they stand: repeated item ids count once a document, repeated documents are each judged;
* empty tables give an empty result or no hits; other columns are ignored by contamination() and kept by decontaminate().
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import ALNUM_WORDS, discard, materialize, shards, utf8_parts, words_of

WINDOW = 10
#: A suffix array is made over about so many bytes of text.
SHARD_BYTES = 8 << 20
#: Most bytes of benchmark text that are broadcast at once.
BROADCAST_BYTES = 16 << 20


class Bench:
    """Windows of a block of benchmark items over a vocabulary of word hashes."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        raw = [t.encode() for _, t in items]
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=offsets[1:])
        hashes, at = words_of(np.frombuffer(b"".join(raw), np.uint8), offsets, ALNUM_WORDS)
        self.vocabulary = np.unique(hashes)
        self.words = np.append(np.searchsorted(self.vocabulary, hashes).astype(np.int64) + 1, np.zeros(window, np.int64))
        start, size, owner, place = [], [], [], []
        for i, (item, _) in enumerate(items):
            n = int(at[i + 1] - at[i])
            if n:
                k = max(1, n - window + 1)
                start.append(at[i] + np.arange(k))
                size.append(np.full(k, min(n, window)))
                owner.append(np.full(k, item))
                place.append(np.arange(k))
        whole = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.start, self.size, self.owner, self.place = whole(start), whole(size), whole(owner), whole(place)
        self.least = int(self.size.min(initial=window))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the suffixes' first `depth` words, by prefix doubling."""
    rank, done = words.astype(np.int64), 1
    while done < depth:
        step = min(done, depth - done)
        later = np.zeros(len(rank), np.int64)
        later[: len(rank) - step] = rank[step:]
        _, rank = np.unique(rank * (int(later.max(initial=0)) + 1) + later, return_inverse=True)
        done += step
    return np.argsort(rank, kind="stable")


def _bounds(words: np.ndarray, order: np.ndarray, bench: Bench) -> tuple[np.ndarray, np.ndarray]:
    """For every window, the range of the suffix array whose suffixes begin with it."""

    def search(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(bench.start), np.int64), np.full(len(bench.start), len(order), np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            before = np.zeros(len(open_), bool)
            equal = np.ones(len(open_), bool)
            for j in range(bench.window):
                live = np.flatnonzero(equal & (bench.size[open_] > j))
                if not len(live):
                    break
                x, y = words[order[mid[live]] + j], bench.words[bench.start[open_[live]] + j]
                before[live[x < y]] = True
                equal[live[x != y]] = False
            right = before | equal if upper else before
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    return search(False), search(True)


def shard_matches(hashes: np.ndarray, at: np.ndarray, bench: Bench) -> tuple[np.ndarray, np.ndarray]:
    """(positions of words where a window begins, its number) over all documents of a shard."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(bench.start):
        return none, none
    place = np.minimum(np.searchsorted(bench.vocabulary, hashes), len(bench.vocabulary) - 1)
    known = bench.vocabulary[place] == hashes
    n = len(hashes)
    # runs of benchmark words inside a document; shorter ones than any window can't hold a match
    first = np.zeros(n + 1, bool)
    first[at[:-1]] = True
    begins = known & (first[:n] | ~np.append(False, known[:-1]))
    run = np.cumsum(begins) - 1
    length = np.bincount(run[known], minlength=max(1, int(begins.sum())))
    keep = np.flatnonzero(known & (length[np.maximum(run, 0)] >= bench.least))
    if not len(keep):
        return none, none
    # the kept runs one after another, 0 between and after them
    gap = np.cumsum(begins[keep]) - 1
    target = np.arange(len(keep)) + gap
    words = np.zeros(len(keep) + int(gap[-1]) + 1 + bench.window, np.int64)
    words[target] = place[keep] + 1
    origin = np.zeros(len(words), np.int64)
    origin[target] = keep
    order = suffix_array(words, bench.window)
    order = order[words[order] > 0]
    lo, hi = _bounds(words, order, bench)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return none, none
    many = hi[hit] - lo[hit]
    which = np.repeat(hit, many)
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return origin[order[np.repeat(lo[hit], many) + inside]], which


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")


def _block_count(benchmark: DataFrame, block_bytes: int) -> int:
    total = _items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def _block(benchmark: DataFrame, window: int, block: int, blocks: int):
    """One block of the benchmark as a broadcast; its size is bounded by how blocks are cut."""
    rows = _items(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
    return benchmark.sparkSession.sparkContext.broadcast(Bench(sorted((r[0], r[1]) for r in rows), window))


def _matches(hashes: np.ndarray, at: np.ndarray, bench: Bench):
    """Maximal verbatim matches as (row, item, first word in the row, first word in the item, words)."""
    position, which = shard_matches(hashes, at, bench)
    if not len(position):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    doc = np.searchsorted(at, position, side="right") - 1
    begin, place, size, owner = position - at[doc], bench.place[which], bench.size[which], bench.owner[which]
    order = np.lexsort((begin, begin - place, owner, doc))
    doc, begin, place, size, owner = (x[order] for x in (doc, begin, place, size, owner))
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (begin[1:] - place[1:] != begin[:-1] - place[:-1]) | (begin[1:] > begin[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(order)) - 1
    return doc[starts], owner[starts], begin[starts], place[starts], begin[ends] + size[ends] - begin[starts]


def _covered(n_rows: int, at: np.ndarray, doc: np.ndarray, begin: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many words of each row lie in a match."""
    cover = np.zeros(int(at[-1]) + 1, np.int64)
    np.add.at(cover, at[doc] + begin, 1)
    np.add.at(cover, at[doc] + begin + words, -1)
    hit = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
    return hit[at[1:]] - hit[at[:-1]]


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, longest_match long"


def _report(ids, n_words, n_hit, items, longest):
    import pyarrow as pa

    names = [sorted(map(str, x)) for x in items]
    digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digests, pa.string()), pa.array(np.asarray(n_hit) > 0), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int64())],
        [c.split()[0] for c in SCHEMA.split(", ")],
    )


def _judged(batch, bench: Bench):
    """Per row: words, hit words, the ids of occurring items, words of the longest match."""
    hashes, at = words_of(*utf8_parts(batch.column("text")), ALNUM_WORDS)
    n = batch.num_rows
    doc, owner, begin, _, words = _matches(hashes, at, bench)
    items, longest = [set() for _ in range(n)], np.zeros(n, np.int64)
    for row, item in set(zip(doc.tolist(), owner.tolist())):
        items[row].add(item)
    np.maximum.at(longest, doc, words)
    return np.diff(at), _covered(n, at, doc, begin, words), items, longest


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """-> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted as strings), longest_match (words)."""
    slim, blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _block_count(benchmark, block_bytes)
    if blocks > 1:
        return _by_blocks(slim, benchmark, window, blocks)
    shared = _block(benchmark, window, 0, 1)

    def run(batches):
        for batch in shards(batches, "text", SHARD_BYTES):
            yield _report(batch.column("doc_id"), *_judged(batch, shared.value))

    return slim.mapInArrow(run, SCHEMA)


def _row_key():
    """Rows of equal id and text have equal keys, and equal results."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), F.col("text"), F.col("doc_id")).alias("k2")]


def _by_blocks(docs: DataFrame, benchmark: DataFrame, window: int, blocks: int) -> DataFrame:
    """contamination() with one pass a block. Matches of a row are few; they are grouped by row and united."""
    keyed = docs.select(*_row_key(), "doc_id", "text")
    found = None
    for b in range(blocks):
        shared = _block(benchmark, window, b, blocks)

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in shards(batches, "text", SHARD_BYTES):
                hashes, at = words_of(*utf8_parts(batch.column("text")), ALNUM_WORDS)
                doc, owner, begin, _, words = _matches(hashes, at, shared.value)
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(rows), batch.column("k2").take(rows), pa.array(owner), pa.array(begin), pa.array(words)], ["k1", "k2", "item", "begin", "words"])

        part = materialize(keyed.mapInArrow(run, "k1 long, k2 long, item long, begin long, words long").distinct(), "bench-hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    spans = F.array_sort(F.collect_set(F.struct("begin", "words")))
    # united length of sorted spans: what reaches beyond the end so far counts
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, s):
        end = s["begin"] + s["words"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(acc["end"], s["begin"]))).alias("n"))

    per = found.groupBy("k1", "k2").agg(F.aggregate(spans, start, step, lambda acc: acc["n"]).alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"), F.max("words").alias("longest_match"))

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            _, at = words_of(*utf8_parts(batch.column("text")), ALNUM_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("doc_id"), pa.array(np.diff(at))], ["k1", "k2", "doc_id", "n_words"])

    rows = keyed.mapInArrow(count, "k1 long, k2 long, doc_id long, n_words long").join(per, ["k1", "k2"], "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", none), "longest_match": F.coalesce("longest_match", F.lit(0)).cast("long")})
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "longest_match")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Maximal verbatim matches: doc_id, item_id, doc_word, item_word, n_words. A block of the benchmark a pass, as above."""
    slim, blocks, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _block_count(benchmark, block_bytes), None
    for b in range(blocks):
        shared = _block(benchmark, window, b, blocks)

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in shards(batches, "text", SHARD_BYTES):
                hashes, at = words_of(*utf8_parts(batch.column("text")), ALNUM_WORDS)
                doc, *found = _matches(hashes, at, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *map(pa.array, found)], ["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        part = slim.mapInArrow(run, "doc_id long, item_id long, doc_word long, item_word long, n_words long")
        if blocks > 1:
            part = materialize(part, "bench-matches")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without contaminated rows, all columns kept; one pass a block, no shuffle."""
    blocks = _block_count(benchmark, block_bytes)
    for b in range(blocks):
        shared = _block(benchmark, window, b, blocks)

        def run(batches, shared=shared):
            import pyarrow as pa

            for batch in shards(batches, "text", SHARD_BYTES):
                yield batch.filter(pa.array(_judged(batch, shared.value)[1] == 0))

        left = docs.mapInArrow(run, docs.schema)
        if blocks > 1:
            left = materialize(left, "bench-left")
            shared.destroy()
            if b:
                discard(docs)
        docs = left
    return docs
