"""Periodic runs of words: every maximal repetition of a document, and the text with each run cut to its first period.

For a period p, two places p words apart on the grid of the multiples of p lie in every stretch of 2p words with that period. So
for each p the grid is walked (n/p places, n log n in all), and where both places hold the same word, the longest common
extensions to the right and to the left give the stretch. Extensions take a few steps:

* a difference cover of COVER residues says after how many words (under COVER) both places fall on sampled places; so many words
  are compared one by one;
* only suffixes at sampled places are sorted, by their first COVER words, then by doubling, ties alone;
* from there on the extension is a minimum over the sorted samples' common prefixes, read from a sparse table.

To the left the same is done on the words reversed. Documents of like length are laid side by side, each between words of its
own that occur nowhere else, so no stretch leaves its document and numpy works on some 65,000 words at once.

Defined results
* words are `[^\\x20\\x09-\\x0D]+`; a run has length >= max(12, 2 * period), its smallest period, and no longer neighbour;
* null and empty text, and text without words: no runs, the four numbers of the longest run are null, and the digests are those
  of the empty string; text without runs: its words joined by one space;
* every row is worked on by itself, repeated rows alike; rows with a null doc_id too (they are never rewritten by `rewritten`);
* an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import SPACE_SEPARATED, shards, utf8_parts

MIN_LENGTH = 12
#: A perfect difference cover: every distance between residues mod COVER is one between two members of RESIDUES.
COVER, RESIDUES = 31, (1, 5, 11, 24, 25, 27)
#: Words worked on at once (a longer document stands alone), pairs of grid places looked at once, bytes of text decoded at once.
GROUP_WORDS, PAIRS, SHARD_BYTES = 1 << 16, 1 << 20, 8 << 20
_MEMBER = np.zeros(COVER, bool)
_MEMBER[list(RESIDUES)] = True
_places = (np.arange(COVER)[:, None] + np.arange(COVER)) % COVER
#: SHIFT[a, b]: the least number of words after which residues a and b are both in the cover.
SHIFT = (_MEMBER[_places][:, None, :] & _MEMBER[_places][None, :, :]).argmax(axis=2)


class Extensions:
    """Longest common extensions to the right of any two places of an array whose last word occurs nowhere else."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.ids = np.append(ids, np.zeros(COVER, np.int64))
        self.sampled = np.flatnonzero(_MEMBER[np.arange(self.n) % COVER])
        self.slot = np.full(self.n, -1, np.int64)
        self.slot[self.sampled] = np.arange(len(self.sampled))
        rank, levels = self._sorted()
        self.rank = rank
        self.table = self._minima(self._prefixes(rank, levels))

    def _sorted(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ranks of the sampled suffixes, and for block lengths COVER * 2^k the ranks that say which blocks are equal, as long as
        some are."""
        rank, open_ = np.zeros(len(self.sampled), np.int64), np.arange(len(self.sampled))
        bits = max(1, int(self.ids.max()).bit_length())
        step = max(1, 63 // bits)
        for first in range(0, COVER, step):
            if not len(open_):
                break
            at, key = self.sampled[open_] + first, np.zeros(len(open_), np.int64)
            for t in range(min(step, COVER - first)):
                key = (key << bits) | self.ids[at + t]
            open_ = self._split(rank, open_, key)
        levels, reach = [], COVER
        while len(open_):
            levels.append(rank.copy())
            ahead = self.sampled[open_] + reach
            key = np.where(ahead < self.n, levels[-1][self.slot[np.minimum(ahead, self.n - 1)]], -1)
            open_ = self._split(rank, open_, key)
            reach *= 2
        return rank, levels

    @staticmethod
    def _split(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Order the members of each tie by key, in place; what is still tied comes back. A rank is the number of smaller ones."""
        order = np.lexsort((key, rank[open_]))
        items, keys = open_[order], key[order]
        ranks = rank[items]
        index = np.arange(len(items))
        old = np.append(True, ranks[1:] != ranks[:-1])
        new = old | np.append(True, keys[1:] != keys[:-1])
        base = np.maximum.accumulate(np.where(old, index, 0))
        first = np.maximum.accumulate(np.where(new, index, 0))
        rank[items] = ranks + first - base
        alone = new & np.append(new[1:], True)
        return items[~alone]

    def _prefixes(self, rank: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefix lengths of neighbours in the order of the samples."""
        order = np.empty(len(rank), np.int64)
        order[rank] = self.sampled
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.maximum(a, b) < self.n
            same = inside & (levels[k][self.slot[np.minimum(a, self.n - 1)]] == levels[k][self.slot[np.minimum(b, self.n - 1)]])
            for x in (a, b, length):
                x += same * (COVER << k)
        return length + self._compare(a, b, np.full(len(a), COVER))

    def _compare(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from a and b on, at most so many (under COVER + 1), one after another."""
        length = np.zeros(len(a), np.int64)
        going = np.flatnonzero(most > 0)
        for t in range(COVER):
            going = going[self.ids[a[going] + t] == self.ids[b[going] + t]]
            length[going] += 1
            going = going[most[going] > t + 1]
            if not len(going):
                break
        return length

    @staticmethod
    def _minima(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values.astype(np.int32)], 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths for places a and b, a != b."""
        shift = SHIFT[a % COVER, b % COVER]
        length = self._compare(a, b, shift)
        on = np.flatnonzero(length == shift)
        one, two = (self.rank[self.slot[np.minimum(x[on] + shift[on], self.n - 1)]] for x in (a, b))
        low, high = np.minimum(one, two), np.maximum(one, two)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            here = level == k
            at = on[here]
            length[at] += np.minimum(self.table[k][low[here]], self.table[k][high[here] - (1 << int(k))])
        return length


def _grid(ids: np.ndarray, longest: int):
    """Blocks of (place, period) where neighbours on the grid of a period hold the same word, for periods up to longest."""
    n, held, size = len(ids), [], 0

    def block():
        return np.concatenate([i for i, _ in held]), np.concatenate([np.broadcast_to(p, i.shape) for i, p in held])

    period = 1
    while period <= longest:
        if n // period > 64:
            line = ids[::period]
            places = np.flatnonzero(line[1:] == line[:-1]) * period
            periods, looked = np.int64(period), len(line)
            period += 1
        else:
            upto = min(longest + 1, period + max(1, PAIRS // 64))
            some = np.arange(period, upto)
            count = (n - 1) // some
            periods = np.repeat(some, count)
            places = (np.arange(len(periods)) - np.repeat(np.cumsum(count) - count, count)) * periods
            same = ids[places] == ids[places + periods]
            places, periods, looked = places[same], periods[same], len(same)
            period = upto
        if len(places):
            held.append((places, periods))
        size += len(places) + looked // 64
        if held and size >= PAIRS:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def find_runs(ids: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs, by start and period, of an array that begins and ends with words that occur once;
    `longest` bounds the periods."""
    right, left, n = Extensions(ids), Extensions(ids[::-1]), len(ids)
    found = np.zeros((3, 0), np.int64)
    for place, period in _grid(ids, longest):
        after = right(place, place + period)
        before = left(n - place, n - place - period)
        good = (after + before >= period) & (after + before + period >= MIN_LENGTH)
        new = np.stack([place - before, after + before + period, period])[:, good]
        found = np.concatenate([found, new], axis=1)
        # one stretch is found at many places, and for multiples of its period: the smallest period stays
        order = np.lexsort((found[2], found[1], found[0]))
        found = found[:, order]
        found = found[:, np.append(True, (found[:2, 1:] != found[:2, :-1]).any(axis=0))] if found.shape[1] else found
    return found[:, np.lexsort((found[2], found[0]))]


def _words(column) -> tuple[object, np.ndarray, np.ndarray]:
    """All words of a text column as one Arrow array, their numbers (equal words alike), and each row's first word."""
    import pyarrow as pa

    data, offsets = utf8_parts(column)
    inside = SPACE_SEPARATED[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    joined = inside[:-1] & inside[1:] & ~edge[1:-1]
    starts = np.flatnonzero(inside & ~np.append(False, joined)) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & ~np.append(joined, False)) + 1 if len(data) else starts
    at = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
    return words, words.dictionary_encode().indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets)


def rewritten(doc_id, n: int) -> np.ndarray:
    """Which original word stands at each of n places: for one document in ten, by its id's crc32, the words from some place on
    repeat with a long period."""
    order = np.arange(n)
    if doc_id is None or not n:
        return order
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[a:] = a + np.arange(n - a) % p
    return order


def _groups(counts: np.ndarray):
    """Rows by number of words, in groups of about GROUP_WORDS words; rows without words stay out."""
    order = np.argsort(counts, kind="stable")
    group, size = [], 0
    for row in order[counts[order] > 0].tolist():
        if group and size + counts[row] > GROUP_WORDS:
            yield group
            group, size = [], 0
        group.append(row)
        size += int(counts[row]) + 1
    if group:
        yield group


EMPTY = hashlib.sha256(b"").hexdigest()


def runs_of_batch(column, doc_ids: list, rewrite=None) -> tuple[list[np.ndarray], list[bytes]]:
    """For each text its runs (start, length, period, by start and period) and its words with each run cut to its first period,
    joined by one space. rewrite(doc_id, n) may name the word that stands at each place."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words, ids, first = _words(column)
    counts = np.diff(first)
    runs, texts = [np.zeros((3, 0), np.int64)] * len(counts), [b""] * len(counts)
    own = int(ids.max()) + 1 if len(ids) else 0
    for group in _groups(counts):
        # a word of its own before each document and behind the last
        at = np.append(0, np.cumsum(counts[group] + 1))
        line, source = np.empty(at[-1] + 1, np.int64), np.empty(at[-1] + 1, np.int64)
        line[at] = own + np.arange(len(at))
        inner = np.ones(len(line), bool)
        inner[at] = False
        for row, begin in zip(group, at):
            n = int(counts[row])
            order = np.arange(n) if rewrite is None else rewrite(doc_ids[row], n)
            source[begin + 1 : begin + 1 + n] = first[row] + order
        line[inner] = ids[source[inner]]
        found = find_runs(line, int(counts[group].max()) // 2)
        change = np.zeros(len(line) + 1, np.int64)
        np.add.at(change, found[0] + found[2], 1)
        np.add.at(change, found[0] + found[1], -1)
        kept = inner & (np.cumsum(change[:-1]) == 0)
        cuts = np.append(0, np.cumsum(kept))[at].astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words.take(pa.array(source[kept])).cast(pa.binary())), b" ")
        owner = np.searchsorted(at, found[0], side="right") - 1
        parts = np.searchsorted(owner, np.arange(len(group) + 1))
        for k, row in enumerate(group):
            one = found[:, parts[k] : parts[k + 1]].copy()
            one[0] -= at[k] + 1
            runs[row], texts[row] = one, joined[k].as_py()
    return runs, texts


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, rewrite=None) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_runs, the longest run (ties: smallest start, then period), and digests of all runs
    and of the text with each run cut to its first period. One pass, no shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in shards(batches, "text", SHARD_BYTES):
            doc_ids = batch.column("doc_id").to_pylist()
            runs, texts = runs_of_batch(batch.column("text"), doc_ids, rewrite)
            rows = []
            for doc, one, text in zip(doc_ids, runs, texts):
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in one.T.tolist())
                best = (None,) * 4
                if one.shape[1]:
                    start, length, period = one[:, np.lexsort((one[2], one[0], -one[1]))[0]].tolist()
                    best = (start, length, period, 1000 * length // period)
                rows.append((doc, one.shape[1], *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def collapse(docs: DataFrame, rewrite=None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text (words joined by one space, each run cut to its first period; null stays null) and
    runs, an array of (start, length, period)."""

    def run(batches):
        import pyarrow as pa

        for batch in shards(batches, "text", SHARD_BYTES):
            runs, texts = runs_of_batch(batch.column("text"), batch.column("doc_id").to_pylist(), rewrite)
            null = batch.column("text").is_null().to_pylist()
            listed = pa.array([[dict(zip(("start", "length", "period"), x)) for x in one.T.tolist()] for one in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if no else t.decode("utf-8", "replace") for no, t in zip(null, texts)], pa.string()), listed], ["doc_id", "text", "runs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, runs array<struct<start:long,length:long,period:long>>")
