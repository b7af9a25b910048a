"""How five corpus filters interact: what each removes, repeats and loses in every order of applying them.

Words are encoded by a global dictionary, and documents are rows of a sparse document-term matrix in CSR shards: a shard holds
about SHARD_BYTES of text as row pointers, word codes and counts. A row's sum is its number of words and its number of nonzero
entries that of its distinct words; they decide filters A and B. The flags of C, D and E are attached to the same rows, and rows
are counted by (part, which filters fail): 32 cells a part, from which all 120 orders follow by arithmetic.

The dictionary: a word's code is 63 bits of its hash. The dictionary holds each distinct word of the table once; words that
share a hash are found in it and get codes of their own, below zero, so codes are one-to-one. Only those (about one in 10^9
words) are sent to the tasks; everything else of a code follows from the word, so neither words nor matrix entries are joined.

Filters (a document fails): A under 100 words; B 100 * distinct words < 80 * words; C 100 * [A-Z] > 10 * code points; D any of
`#$%&*|`; E a smaller doc_id has the same text. Words are maximal runs of anything but space and \\x09-\\x0D.

Defined results
* null text is empty text: it fails A, and E where an empty text has a smaller doc_id;
* a null doc_id is never the smaller one and never fails E; rows that repeat count each; of rows with the same id and text none
  fails E for the other's sake;
* null `lang` is the part '', as an empty one; a document without a label is neither good nor toxic, and one with several is what
  any of them says;
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import SPACE_SEPARATED, batches_of, discard, materialize, shards, utf8_parts, words_of

LETTERS = "ABCDE"
SHARD_BYTES, DICTIONARY_BYTES = 2 << 20, 4 << 20
#: Rows of a side that may be broadcast (some 10 MB); beyond, it is copied for SALTS shares of the documents and shuffled.
BROADCAST_ROWS, SALTS = 200_000, 16
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*|")] = True
ORDERS = ["".join(p) for p in permutations(LETTERS)]


def _encoded(column, bits: int):
    """Of the words of a text column: their rows, their places in the distinct words, those words, and a code for each."""
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
    coded = words.dictionary_encode()
    distinct = coded.dictionary
    # the distinct words, a space between them, in blocks of bounded size
    raw, ends = utf8_parts(distinct)
    blocks = np.append(np.arange(0, len(distinct), 1 << 14), len(distinct))
    hashes, _ = words_of(np.insert(raw, ends[1:-1], 32) if len(distinct) else raw, ends[blocks] + np.minimum(blocks, max(len(distinct) - 1, 0)), SPACE_SEPARATED, lower=False)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, coded.indices.to_numpy().astype(np.int64), distinct, (hashes >> np.uint64(64 - bits)).astype(np.int64)


def shared_codes(docs: DataFrame, bits: int = 63) -> dict[bytes, int]:
    """The words whose hash is also another word's, with codes of their own; the smallest word of a hash keeps it.

    This is where the whole dictionary is built: each distinct word of the table is one row, dealt by its code."""

    def found(batches):
        import pyarrow as pa

        for batch in shards(batches, "text", DICTIONARY_BYTES):
            _, _, distinct, codes = _encoded(batch.column("text"), bits)
            for first in range(0, len(codes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(codes[first : first + (1 << 16)]), distinct.slice(first, 1 << 16).cast(pa.binary())], ["code", "word"])

    dictionary = docs.select("text").mapInArrow(found, "code long, word binary").repartition("code").distinct()
    clash = [r["code"] for r in dictionary.groupBy("code").count().where("count > 1").select("code").collect()]
    if not clash:
        return {}
    sharing = docs.sparkSession.createDataFrame([(c,) for c in clash], "code long")
    words: dict[int, list[bytes]] = {}
    for r in dictionary.join(F.broadcast(sharing), "code").collect():
        words.setdefault(r["code"], []).append(bytes(r["word"]))
    return {w: -1 - i for i, w in enumerate(sorted(w for ws in words.values() for w in sorted(ws)[1:]))}


SHARD = "doc_id array<long>, part array<string>, indptr array<int>, indices array<long>, counts array<int>, upper array<long>, points array<long>, symbols array<boolean>, digest array<binary>"


def csr_shards(docs: DataFrame, bits: int = 63) -> DataFrame:
    """docs (doc_id, text, lang) -> CSR shards of the document-term matrix with what the other filters need of each row.

    Row i of a shard has entries indptr[i] to indptr[i + 1]: word codes (rising) and counts. A shard is about SHARD_BYTES of
    text, or one longer document.
    """
    own = docs.sparkSession.sparkContext.broadcast(shared_codes(docs, bits))

    def run(batches):
        import pyarrow as pa

        for batch in shards(batches, "text", SHARD_BYTES):
            column, n = batch.column("text"), batch.num_rows
            rows, places, distinct, codes = _encoded(column, bits)
            if own.value:
                codes = np.array([own.value.get(w, c) for w, c in zip(distinct.to_pylist(), codes.tolist())], np.int64)
            width = max(len(codes), 1)
            order = np.argsort(codes, kind="stable")
            rank = np.empty(len(codes), np.int64)
            rank[order] = np.arange(len(codes))
            key, counts = np.unique(rows * width + rank[places], return_counts=True)
            indptr = np.searchsorted(key, np.arange(n + 1) * width).astype(np.int32)
            data, offsets = utf8_parts(column)
            total = lambda mask: np.diff(np.append(0, np.cumsum(mask))[offsets])
            raw = data.tobytes()
            digest = [hashlib.blake2b(raw[offsets[i] : offsets[i + 1]], digest_size=16).digest() for i in range(n)]
            values = [batch.column("doc_id"), batch.column("part"), indptr, codes[order][key % width], counts.astype(np.int32), total((data >= 65) & (data <= 90)), total((data & 0xC0) != 0x80), total(_SYMBOLS[data]) > 0, pa.array(digest, pa.binary())]
            lists = []
            for v in values:
                v = v if isinstance(v, pa.Array) else pa.array(v)
                lists.append(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v))
            yield pa.RecordBatch.from_arrays(lists, ["doc_id", "part", "indptr", "indices", "counts", "upper", "points", "symbols", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, SHARD)


def row_flags(matrix: DataFrame) -> DataFrame:
    """Shards -> doc_id, part, digest, n_words, n_distinct and `fails`, the bits of A to D, a row per document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name).slice(i, 1).flatten() for name in batch.schema.names}
                indptr, upper, points = (one[c].to_numpy() for c in ("indptr", "upper", "points"))
                words = np.diff(np.append(0, np.cumsum(one["counts"].to_numpy(), dtype=np.int64))[indptr])
                distinct = np.diff(indptr).astype(np.int64)
                symbols = one["symbols"].to_numpy(zero_copy_only=False)
                fails = (words < 100) + 2 * (100 * distinct < 80 * words) + 4 * (100 * upper > 10 * points) + 8 * symbols
                yield pa.RecordBatch.from_arrays([one["doc_id"], one["part"], one["digest"], pa.array(words), pa.array(distinct), pa.array(fails.astype(np.int32))], ["doc_id", "part", "digest", "n_words", "n_distinct", "fails"])

    return matrix.mapInArrow(run, "doc_id long, part string, digest binary, n_words long, n_distinct long, fails int")


def _beside(rows: DataFrame, side: DataFrame, key: str, salt) -> DataFrame:
    """rows left-joined with side (key once each, written). A small side is broadcast, behind a count; of a larger one each row
    is copied for SALTS shares of the documents, so that a key that a third of all rows hold is many tasks' work. The hint is
    needed: the planner goes by the size of side's files, takes no account of the copies, and would broadcast them all."""
    if side.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side), key, "left")
    copies = side.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", F.pmod(salt, F.lit(SALTS))).join(copies.hint("merge"), [key, "salt"], "left").drop("salt")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), n, good, toxic: at most 32 rows a part."""
    with batches_of(docs.sparkSession, 8):
        rows = materialize(row_flags(csr_shards(docs)).select("doc_id", "part", "digest", "fails"), "audit-rows")
    again = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "audit-copies")
    marked = _beside(rows, again, "digest", F.xxhash64("doc_id"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = materialize(known, "audit-labels")
    marked = _beside(marked, known, "doc_id", F.xxhash64("digest"))
    fails = F.col("fails") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    out = marked.groupBy("part", fails.alias("fails")).agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    out = materialize(out, "audit-cells")
    discard(rows, again, known)
    return out


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step -> kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - 65)
    each = cells(docs, labels).withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in ORDERS]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    places = F.transform(F.sequence(F.lit(1), F.lit(len(LETTERS))), lambda k: F.when(k < F.col("step"), bit_of(F.substring("filter_order", k, F.lit(1)))).otherwise(0))
    each = each.withColumns({"bit": bit_of(F.substring("filter_order", F.col("step"), F.lit(1))), "before": F.aggregate(places, F.lit(0), lambda a, b: a.bitwiseOR(b))})
    fails, was_gone = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0
    # over all orders a document falls to each of its failing filters equally often
    share = F.col("n") * (F.lit(len(ORDERS)) / F.bit_count("fails")).cast("long")
    amount = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    return each.groupBy("part", "filter_order", "step").agg(
        amount(~fails & ~was_gone).alias("kept"),
        amount(fails & ~was_gone).alias("removed"),
        amount(fails & was_gone).alias("redundant"),
        amount(F.col("fails") == F.col("bit")).alias("unique_fails"),
        amount(fails & ~was_gone, "good").alias("good_lost"),
        amount(fails & ~was_gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).alias("shapley"),
    )


ORACLE = """
with d as (
  select coalesce(lang, '') as part, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    min(doc_id) over (partition by coalesce(text, '')) as first
  from documents
), l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (
  select part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > first, false)::int as fails, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from d left join l on d.doc_id = l.doc_id
), c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as k),
o as (
  select a.k || b.k || c.k || d.k || e.k as filter_order from x a, x b, x c, x d, x e
  where len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), s as (
  select filter_order, step, (1 << (ascii(filter_order[step]) - 65)) as bit, list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))) as before
  from o, (select unnest(range(1, 6)) as step)
), g as (select c.*, s.filter_order, s.step, s.bit, c.fails & s.bit > 0 as hit, c.fails & coalesce(s.before, 0)::int > 0 as gone from c, s),
firsts as (select part, filter_order, step, bit, sum(case when hit and not gone then n else 0 end) as removed from g group by all),
shap as (select part, bit, sum(removed) as shapley from firsts group by all)
select g.part, g.filter_order, g.step::int as step,
  sum(case when not hit and not gone then n else 0 end)::bigint as kept, sum(case when hit and not gone then n else 0 end)::bigint as removed,
  sum(case when hit and gone then n else 0 end)::bigint as redundant, sum(case when fails = g.bit then n else 0 end)::bigint as unique_fails,
  sum(case when hit and not gone then good else 0 end)::bigint as good_lost, sum(case when hit and not gone then toxic else 0 end)::bigint as toxic_lost,
  any_value(shapley)::bigint as shapley
from g join shap using (part, bit) group by g.part, g.filter_order, g.step
"""
