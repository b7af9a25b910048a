"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Defined results
* a vector that is null, or holds a null, NaN or infinite component, takes no part, as query or candidate;
* rows with a null vec_id take no part; candidates are all rows whose vec_id differs from the query's, repeated rows each
  count; of a query given several times the vector that sorts first is asked, once;
* components and scores of any finite size are exact; a score beyond 64 bits is reported as the nearest one within;
* only vectors of the query's length are its candidates; fewer than k candidates give all of them;
* ties go to the smaller vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize

SCALE = 1024
#: Queries travel to the tasks in blocks of at most so many bytes; each block is one pass over the candidates. With several
#: blocks, one is done, written and let go before the next one is sent.
BLOCK_BYTES = 16 << 20
FIRST_DEPTH = 64
#: Candidates that get sorted lists together; more stand in several shards.
SHARD_ROWS = 1 << 16


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v: floor(1024 * x) of every component, a whole number in a double, for the vectors that take part."""
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: _floor(x.cast("double") * SCALE)).alias("v"))


def _floor(x):
    """floor() within doubles: a long holds no component beyond 2^63, and a double beyond 2^52 has no fraction."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def _whole(x: np.ndarray) -> np.ndarray:
    """Integers of whole-number doubles: 64 bits where they hold, else Python's."""
    if np.abs(x).max(initial=0) < 2**62:
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)


class Shard:
    """Candidates of one length (whole numbers in doubles) with a sorted list of rows for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.as_float = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.order, axis=0)
        self.largest = float(np.abs(vectors).max(initial=0))
        self.scored = 0

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products: in doubles where they hold them, then in 64 bits, then in Python's integers."""
        self.scored += len(rows)
        reach = self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q))
        if reach < 2**52:
            return (self.as_float[rows] @ q).astype(np.int64)
        x, y = _whole(self.as_float[rows]), _whole(q[None, :])[0]
        if reach < 2**62 and x.dtype != object and y.dtype != object:
            return x @ y
        return np.array([sum(int(a) * int(b) for a, b in zip(row, y)) for row in x], object)

    def search(self, q_id: int, q: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of `best` and this shard; stops once no unseen row can reach the kth score.

        Lists are read from their best ends in rounds, and the dimensions whose lists can still lower the bound most are read
        further in a round than the others.
        """
        n = len(self.ids)
        dims = np.flatnonzero(q)
        seen, scores, ids = np.zeros(n, bool), *best
        if not len(dims):
            dims, ends = np.arange(0), np.array([n])
        # rank 0 is the best row of a list for this query
        best_first = lambda d, r: np.where(q[d] > 0, n - 1 - r, r)
        depth, step = np.zeros(len(dims), np.int64), FIRST_DEPTH
        while True:
            if len(dims):
                front = self.sorted[best_first(dims, np.minimum(depth, n - 1)), dims] * q[dims]
                ahead = self.sorted[best_first(dims, np.minimum(depth + step, n - 1)), dims] * q[dims]
                gain = front - ahead
                far = np.where(gain >= np.median(gain), 2 * step, step)
                ends = np.minimum(depth + far, n)
                now = np.zeros(n, bool)
                for d, a, b in zip(dims, depth, ends):
                    now[self.order[n - b : n - a, d] if q[d] > 0 else self.order[a:b, d]] = True
            else:
                now = np.ones(n, bool)
            now &= ~seen
            seen |= now
            rows = np.flatnonzero(now & (self.ids != q_id))
            if len(rows):
                s = self.scores(rows, q)
                if len(scores) >= k:
                    rows, s = rows[s >= scores[-1]], s[s >= scores[-1]]
                scores, ids = np.concatenate([scores, s]), np.concatenate([ids, self.ids[rows]])
                pick = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[pick], ids[pick]
            depth, step = (ends, step * 2) if len(dims) else (np.array([n]), step)
            if (depth >= n).any():
                return scores, ids
            bound = float((self.sorted[best_first(dims, depth), dims] * q[dims]).sum())
            # a little slack, as the bound is a sum of doubles
            if len(scores) >= k and float(scores[-1]) > bound + 1e-9 * abs(bound):
                return scores, ids


def _searcher(block, k: int):
    def run(batches):
        import pyarrow as pa

        queries = block.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        scored, offered = [0] * len(queries), [0] * len(queries)
        for batch in (b.slice(at, SHARD_ROWS) for b in batches for at in range(0, b.num_rows, SHARD_ROWS)):
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            size = np.diff(np.asarray(lists.offsets))
            base = np.asarray(lists.offsets)
            flat = lists.values.to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                mine = [i for i, (_, q) in enumerate(queries) if len(q) == dim]
                if not mine:
                    continue
                shard = Shard(ids[rows], flat[base[rows][:, None] + np.arange(dim)[None, :]].reshape(len(rows), dim))
                for i in mine:
                    shard.scored = 0
                    best[i] = shard.search(queries[i][0], queries[i][1], k, best.get(i, none))
                    scored[i] += shard.scored
                    offered[i] += len(rows)
        q_ids, v_ids, scores, seen, all_ = [], [], [], [], []
        clip = lambda s: [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in s]
        for i, (s, ids) in best.items():
            q_ids += [queries[i][0]] * len(s)
            v_ids += ids.tolist()
            scores += clip(s)
            seen += [scored[i]] * len(s)
            all_ += [offered[i]] * len(s)
        if q_ids:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q_ids, v_ids, scores, seen, all_)], ["query_id", "vec_id", "score", "scored", "offered"])

    return run


def found_by_block(candidates: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k best of each query in each partition of candidates: query_id, vec_id, score, and how many of the rows offered
    were scored before the bound stopped the search."""
    spark = candidates.sparkSession
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    count, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-(count or 0) * 8 * (width or 0) // block_bytes))
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        block = spark.sparkContext.broadcast([(r["vec_id"], np.array(r["v"], float)) for r in sorted(rows)])
        part = candidates.select("vec_id", "v").mapInArrow(_searcher(block, k), "query_id long, vec_id long, score long, scored long, offered long")
        if blocks > 1:
            part = materialize(part, "top-k")
            block.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Both (vec_id, v) as scaled() gives -> query_id, rank, vec_id, score.

    Queries go out in blocks of bounded size, each with one pass over the candidates' partitions; a task keeps k results
    a query, so what is shuffled is k rows for each query and partition.
    """
    found = found_by_block(candidates, queries, k, block_bytes)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
