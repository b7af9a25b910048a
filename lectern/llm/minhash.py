"""Near-duplicate documents: MinHash bands give candidates, sequential Bayesian tests prune them, full sets decide.

Defined results
* null or wordless text: shingle set is empty (n_shingles 0), linked with nothing, its own component;
* fewer than `words` words: the whole word sequence is the one shingle;
* repeated rows and exact copies: one class, represented by the smallest doc_id, expanded by a join and never into pairs;
* a doc_id that repeats with different texts: each row is a document of its own, linked by its own text; its component_id is
  still the smallest doc_id reachable from it;
* null doc_id: no part in any group; component_id and kept are null;
* empty table: empty result with the same columns; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import SPACE_SEPARATED, batches_of, discard, materialize, mix64, utf8_parts, words_of
from .components import connected_components

#: Production parameters: five-word shingles, similarity 3/4, 48 bands of 6 hashes (a pair at 0.75 misses all bands
#: with probability 8e-5), batches of 32 hashes, and at most 1e-5 posterior chance to prune a true pair per test.
WORDS, SHARE, BANDS, ROWS, BATCH, MISS = 5, (3, 4), 48, 6, 32, 1e-5
HASHES = BANDS * ROWS
BLOCK = 256
#: Members that are checked against one copy of their pivot's text.
GROUP = 512
#: So many document ids (some ten MB) may be broadcast.
BROADCAST_IDS = 1_000_000
#: A class of equal sets with more rows than this is joined by broadcast, apart from the others, so no task gets all of it.
HOT_ROWS = 20_000

_rng = np.random.default_rng(20_011)
_MULTIPLY = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_set(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return mix64((words * _PLACES[:n]).sum(keepdims=True) ^ _PLACES[size + n : size + n + 1])
    total = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        total += words[j : n - size + 1 + j] * _PLACES[j]
    return np.unique(mix64(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima, cut to 16 bits each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(best, (x[i : i + 512, None] * _MULTIPLY[None, :] + _ADD[None, :]).min(axis=0), out=best)
    return (best & np.uint32(0xFFFF)).astype(np.uint16)


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    one = np.bitwise_xor.reduce(mix64(shingles))
    two = np.add.reduce(mix64(shingles * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7)))
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _sign(batches):
    import pyarrow as pa

    for batch in batches:
        data, offsets = utf8_parts(batch.column("text"))
        words, at = words_of(data, offsets, SPACE_SEPARATED)
        n = len(offsets) - 1
        counts, ones, twos, sigs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
        for i in range(n):
            s = shingle_set(words[at[i] : at[i + 1]])
            if len(s):
                counts[i], (ones[i], twos[i]), sigs[i] = len(s), _set_key(s), signature(s).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(counts), pa.array(ones), pa.array(twos), pa.array(sigs, pa.binary())], ["doc_id", "th", "n_shingles", "set_a", "set_b", "sig"])


@lru_cache(maxsize=8)
def prune_bounds(share: float = SHARE[0] / SHARE[1], miss: float = MISS, batch: int = BATCH, total: int = HASHES) -> tuple[tuple[int, int], ...]:
    """(hashes seen, fewest matches that keep a pair): below, P(similarity >= share | matches) < miss under a flat prior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    log_p, log_q, bounds = np.log(grid), np.log1p(-grid), []
    for n in range(batch, total + 1, batch):
        least = 0
        for m in range(n + 1):
            log_w = m * log_p + (n - m) * log_q
            w = np.exp(log_w - log_w.max())
            if w[grid >= share].sum() / w.sum() >= miss:
                least = m
                break
        bounds.append((n, least))
    return tuple(bounds)


def bayes_matches(sigs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matching hashes of the pairs of rows (a, b) of sigs (n x HASHES); -1 for pairs pruned after some batch, whose later
    hashes are not compared."""
    steps = sigs.reshape(len(sigs), HASHES // BATCH, BATCH)
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for step, (_, least) in enumerate(prune_bounds()):
        matches[alive] += (steps[a[alive], step] == steps[b[alive], step]).sum(axis=1, dtype=np.int32)
        keep = matches[alive] >= least
        matches[alive[~keep]] = -1
        alive = alive[keep]
        if not len(alive):
            break
    return matches


def _matrix(column) -> np.ndarray:
    return utf8_parts(column)[0].view(np.uint16).reshape(len(column), HASHES)


def _prune(batches):
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        if n:
            both = np.concatenate([_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b"))])
            keep = pa.array(bayes_matches(both, np.arange(n), np.arange(n, 2 * n)) >= 0)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _verify(batches):
    """Exact test on full sets over rows sorted by group: a group's pivot (role 0), whose set is held, then its members."""
    import pyarrow as pa

    num, den = SHARE
    pivot, held = None, None
    for batch in batches:
        kept_a, kept_b = [], []
        data, offsets = utf8_parts(batch.column("text"))
        for i, (a, rid, role) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "rid", "role")))):
            span = data[offsets[i] : offsets[i + 1]]
            if role and pivot != a:
                continue
            found = shingle_set(words_of(span, np.array([0, len(span)]), SPACE_SEPARATED)[0])
            if not role:
                pivot, held = a, found
                continue
            both = len(np.intersect1d(held, found, assume_unique=True))
            if both and den * both >= num * (len(held) + len(found) - both):
                kept_a.append(a)
                kept_b.append(rid)
        yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], ["a", "b"])


def _with_both(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    one = side.select(F.col("rid").alias("a"), F.col(value).alias(f"{value}_a"))
    two = side.select(F.col("rid").alias("b"), F.col(value).alias(f"{value}_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", f"{value}_a", f"{value}_b")


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose rid is among ids (distinct, written), one a rid. Few ids are broadcast, behind a count, so other
    texts stay where they are; beyond, one shuffle sorts them out. Rows of one rid: the one whose text sorts first."""
    some = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rid", "left_semi")
    return some.groupBy("rid").agg(F.min("text").alias("text"))


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among pairs (a, b), a a pivot.

    A pivot's members are dealt into groups of about GROUP, so a pivot of any size is many tasks' work, and its text is sent
    once a group, not once a pair. Only the texts of ids in a pair are moved.
    """
    dealt = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    members = pairs.join(dealt, "a").select("a", F.col("b").alias("rid"), F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), F.lit(1).alias("role"))
    pivots = dealt.select("a", F.col("a").alias("rid"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(0).alias("role"))
    rows = materialize(members.unionByName(pivots), "minhash-groups")
    wanted = materialize(rows.select("rid").distinct(), "minhash-wanted")
    full = rows.join(_only(texts, wanted), "rid").select("a", "g", "role", "rid", "text")
    links = materialize(full.repartition("a", "g").sortWithinPartitions("a", "g", "role").mapInArrow(_verify, "a long, b long"), "minhash-links")
    discard(rows, wanted)
    return links


PAIRS_AT_ONCE = 1 << 17


def _linked_pairs(table):
    """Links among the rows of whole block pairs: role 0 against role 1, across components.

    A pair that shares several buckets is taken up in the first of its common bands only. The Bayesian test prunes, full sets
    decide; a set is made once a block at most.
    """
    from functools import lru_cache

    import pyarrow as pa

    key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "mb", "ab")])
    role, rid, comp, band = (table.column(c).to_numpy() for c in ("role", "rid", "comp", "band"))
    sigs = _matrix(table.column("sig"))
    shared = table.column("buckets").combine_chunks().flatten().to_numpy().reshape(len(rid), BANDS)
    data, offsets = utf8_parts(table.column("text"))

    @lru_cache(maxsize=4 * BLOCK)
    def full_set(row: int) -> np.ndarray:
        span = data[offsets[row] : offsets[row + 1]]
        return shingle_set(words_of(span, np.array([0, len(span)]), SPACE_SEPARATED)[0])

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    first = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
    end = np.append(first[1:], len(rid))
    minors = np.add.reduceat(role == 0, first)
    others = end - first - minors
    sizes = minors * others
    num, den = SHARE
    group = 0
    while group < len(first):
        upto = max(group + 1, int(np.searchsorted(np.cumsum(sizes[group:]), PAIRS_AT_ONCE, side="right")) + group)
        many = sizes[group:upto]
        g = np.repeat(np.arange(group, upto), many)
        local = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        i, j = first[g] + local // np.maximum(others[g], 1), first[g] + minors[g] + local % np.maximum(others[g], 1)
        apart = comp[i] != comp[j]
        i, j = i[apart], j[apart]
        alive = bayes_matches(sigs, i, j) >= 0
        i, j = i[alive], j[alive]
        common = (shared[i] == shared[j]) & (shared[i] != 0)
        here = common.argmax(axis=1) == band[i] if len(i) else alive[:0]
        found = []
        for x, y in zip(i[here].tolist(), j[here].tolist()):
            # components that this task has joined need no second link
            u, v = root(int(comp[x])), root(int(comp[y]))
            if u == v:
                continue
            one, two = full_set(x), full_set(y)
            if num * max(len(one), len(two)) > den * min(len(one), len(two)):
                continue
            both = len(np.intersect1d(one, two, assume_unique=True))
            if den * both >= num * (len(one) + len(two) - both):
                parent[max(u, v)] = min(u, v)
                found.append((min(rid[x], rid[y]), max(rid[x], rid[y])))
        cols = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1])], ["a", "b"])
        group = upto


def _cross(batches):
    """Rows sorted by block pair and role; a block pair that goes on in the next batch waits for it."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("bucket", "mb", "ab")])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
        done = int(cuts[-1]) + 1 if len(cuts) else 0
        if done:
            yield from _linked_pairs(table.slice(0, done).combine_chunks())
        held = table.slice(done)
    if held is not None and held.num_rows:
        yield from _linked_pairs(held.combine_chunks())


def _open_blocks(members: DataFrame, labels: DataFrame, sigs: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of the buckets that hold several components, apart from their pivots, dealt into pairs of blocks: the members
    outside a bucket's main component (role 0) against all of its members (role 1). Also the written tables it reads."""
    where = members.where("rid <> pivot").join(labels.select(F.col("node").alias("rid"), "component"), "rid", "left").select("bucket", "band", "rid", F.coalesce("component", "rid").alias("comp"))
    per = where.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    split = per.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket", "main", "size", (F.col("size") - F.col("top")).alias("minor"))
    open_ = materialize(where.join(split, "bucket").select("bucket", "band", "rid", "comp", (F.col("comp") != F.col("main")).alias("is_minor"), F.ceil(F.col("minor") / BLOCK).cast("int").alias("mbs"), F.ceil(F.col("size") / BLOCK).cast("int").alias("abs_")), "minhash-open")
    mine, theirs = F.pmod(F.xxhash64("rid"), F.col("mbs")).cast("int"), F.pmod(F.xxhash64("rid", F.lit(1)), F.col("abs_")).cast("int")
    as_minor = open_.where("is_minor").select("bucket", "band", "rid", "comp", F.lit(0).alias("role"), mine.alias("mb"), F.explode(F.sequence(F.lit(0), F.col("abs_") - 1)).alias("ab"))
    as_any = open_.select("bucket", "band", "rid", "comp", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"), theirs.alias("ab"))
    # a document's open buckets by band, 0 where it has none
    pairs = F.map_from_entries(F.collect_list(F.struct("band", "bucket")))
    mine_all = open_.groupBy("rid").agg(pairs.alias("m")).select("rid", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0).cast("long"))).alias("buckets"))
    mine_all = materialize(mine_all, "minhash-open-rids")
    full = sigs.join(mine_all, "rid").join(_only(texts, mine_all.select("rid")), "rid")
    blocks = as_minor.unionByName(as_any).join(full, "rid").repartition("bucket", "mb", "ab")
    return blocks.sortWithinPartitions("bucket", "mb", "ab", "role"), [open_, mine_all]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per input row."""
    return _grouped(docs).drop("th")


def _own_ids(classes: DataFrame, texts: DataFrame, signed: DataFrame) -> tuple[DataFrame, DataFrame, int | None]:
    """classes (doc, th, …) and texts (doc_id, text) with `rid`, one a class: its smallest doc_id, or where that is another
    class's too, an id below all others. The third part is the least doc_id, if any doc_id has several texts."""
    several = signed.where("n_shingles > 0 and doc_id is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.min("th").alias("one"), F.max("th").alias("two"))
    twice = materialize(several.where("one <> two").select("doc"), "minhash-twice")
    n = twice.count()
    if not n:
        discard(twice)
        return classes.withColumnRenamed("doc", "rid"), texts.withColumnRenamed("doc_id", "rid"), None
    few = F.broadcast(twice) if n <= BROADCAST_IDS else twice
    lowest = min(classes.agg(F.min("doc")).first()[0], 0)
    place = F.row_number().over(Window.partitionBy("doc").orderBy("set_a", "set_b", "n_shingles"))
    mine = materialize(classes.join(few, "doc", "left_semi").withColumn("place", place).withColumn("rid", F.when(F.col("place") == 1, F.col("doc")).otherwise(F.lit(lowest - 1) - F.monotonically_increasing_id())).drop("place"), "minhash-own-ids")
    others = classes.join(few, "doc", "left_anti").withColumn("rid", F.col("doc"))
    named = mine.select(F.col("doc").alias("doc_id"), "th", "rid")
    own = texts.join(few.withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi").withColumn("th", F.xxhash64("text")).join(named, ["doc_id", "th"]).select("rid", "text")
    rest = texts.join(few.withColumnRenamed("doc", "doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("rid"), "text")
    return others.unionByName(mine), own.unionByName(rest), lowest


def _grouped(docs: DataFrame) -> DataFrame:
    """near_duplicates() with `th`, a hash of the row's text.

    1. one pass makes each document's set size, set hash and signature; equal sets fall into one class;
    2. every class is compared with the least id of each band bucket it lies in (work in proportion to bucket sizes);
    3. in buckets that still hold several components, blocks are compared inside a task, only across components, each pair in
       one bucket: the Bayesian test prunes, full sets decide, and only links leave the task.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(base.withColumn("th", F.xxhash64("text")).mapInArrow(_sign, "doc_id long, th long, n_shingles long, set_a long, set_b long, sig binary"), "minhash-signed")
    classes = materialize(signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min(F.struct("doc_id", "th")).alias("least"), F.first("sig").alias("sig"), F.count("*").alias("n_rows")).select("n_shingles", "set_a", "set_b", "least.th", F.col("least.doc_id").alias("doc"), "sig", "n_rows"), "minhash-classes")
    whole = classes
    classes, texts, lowest = _own_ids(classes, base, signed)
    sigs = classes.select("rid", "sig")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substring("sig", k * 2 * ROWS + 1, F.lit(2 * ROWS)), k))).alias("band", "bucket")
    placed = sigs.select("rid", band)
    shared = placed.groupBy("bucket").agg(F.min("rid").alias("pivot"), F.max("rid").alias("last")).where("pivot < last").select("bucket", "pivot")
    members = materialize(placed.join(shared, "bucket"), "minhash-members")
    met = materialize(members.where("rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")).distinct(), "minhash-pairs")
    kept = materialize(_with_both(met, sigs, "sig").mapInArrow(_prune, "a long, b long"), "minhash-kept")
    links = _confirm(kept, texts)
    labels = connected_components(links, "minhash-cc")
    with batches_of(spark, 1000):
        blocks, read = _open_blocks(members, labels, sigs, texts)
        late = materialize(blocks.mapInArrow(_cross, "a long, b long"), "minhash-cross")
    if late.limit(1).count():
        first, labels = labels, connected_components(links.unionByName(late), "minhash-cc")
        discard(first)
    discard(members, met, kept, links, late, *read)
    named = classes.join(labels.select(F.col("node").alias("rid"), "component"), "rid", "left").select("n_shingles", "set_a", "set_b", "n_rows", *(["doc"] if lowest is not None else []), F.coalesce("component", "rid").alias("component"))
    named = materialize(named, "minhash-named")
    discard(whole, labels)
    if lowest is not None:
        # components under an id of our own go by the smallest doc_id in them
        least = named.where(F.col("component") < lowest).groupBy("component").agg(F.min("doc").alias("first"))
        named = materialize(named.join(least, "component", "left").withColumn("component", F.coalesce("first", "component")).drop("first", "doc"), "minhash-renamed")
    key = ["n_shingles", "set_a", "set_b"]
    hot = named.where(F.col("n_rows") > HOT_ROWS).select(*key, F.col("component").alias("hot"))
    # there are at most rows / HOT_ROWS hot classes; their rows take part in no shuffle, nor do those without words
    known = signed.select("doc_id", "th", *key).join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot, key, "left")
    done = known.where("hot is not null or n_shingles = 0 or doc_id is null").select("doc_id", "th", "n_shingles", F.col("hot").alias("component"))
    rest = known.where("hot is null and n_shingles > 0 and doc_id is not null").join(named, key).select("doc_id", "th", "n_shingles", "component")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return done.unionByName(rest).select("doc_id", "th", "n_shingles", group.alias("component_id"), (F.col("doc_id") == group).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; columns stay. Rows with a null doc_id stay."""
    gone = _grouped(docs).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("th").alias("__text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["__text"]), "left_anti")
