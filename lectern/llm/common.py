"""Shared helpers of the corpus operators: the shared work folder, crc folds and byte-level views of Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
SEGMENT_BYTES = 1 << 20

SPACE_SEPARATED = np.ones(256, bool)
SPACE_SEPARATED[[9, 10, 11, 12, 13, 32]] = False
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[ord("0") : ord("9") + 1] = True
ALNUM_WORDS[ord("a") : ord("z") + 1] = True
ALNUM_WORDS[128:] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. A local session that names none gets a
    temporary folder of its own; on a cluster that is an error, as executors could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="spark-shared-")
        found = _own_folders[app]
    return found.rstrip("/")


_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, known to clear_scratch()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for these frames; call it only when all that reads them is written."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this session's operators left in the shared folder. For callers that have written their results: a result
    that is still to be read may rest on such a table."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs that run inside; the session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32(doc_id as text) mod 4 is 2. A null id is held out as well."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def utf8_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the offsets of its rows; a null row is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def shards(batches, column: str, limit: int):
    """Record batches cut anew so that each holds about `limit` bytes of a text column: small ones are joined, large ones
    sliced by whole rows. A longer row stands alone."""
    import pyarrow as pa

    held, size = [], 0

    def whole():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        _, offsets = utf8_parts(batch.column(column))
        for first, end in segments(offsets, limit):
            part = int(offsets[end] - offsets[first])
            if held and size + part > limit:
                yield whole()
                held, size = [], 0
            held.append(batch.slice(first, end - first))
            size += part
    if held:
        yield whole()


def segments(offsets: np.ndarray, limit: int = SEGMENT_BYTES):
    """Runs (first row, end row) of whole rows holding about `limit` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_PRIME, _INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _powers[i] = np.cumprod(row)
    return _powers[0], _powers[1]


def _hash_block(block: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(block) + 2, np.int8)
    inside[1:-1] = is_word[block]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _power_tables(len(block))
    total = np.zeros(len(block) + 1, np.uint64)
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)], out=total[1:])
    return starts, mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of rows in `data`, and for each row the index of its first word.

    Words are lower-cased (A-Z only) unless `lower` is off. Work goes block by block, so memory does not follow the length of a row.
    """
    fold = _LOWER if lower else _SAME
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for row in range(len(offsets) - 1):
        pass_from, end = int(offsets[row]), int(offsets[row + 1])
        if end - pass_from <= 4 * SEGMENT_BYTES:
            continue
        # a very long row: cut at separators
        while pass_from < end:
            upto = min(pass_from + SEGMENT_BYTES, end)
            while upto < end:
                tail = np.flatnonzero(~is_word[fold[data[pass_from:upto]]])
                if len(tail):
                    upto = pass_from + int(tail[-1]) + 1
                    break
                upto = min(upto + SEGMENT_BYTES, end)
            _, h = _hash_block(fold[data[pass_from:upto]], is_word)
            hashes.append((row, h))
            counts[row] += len(h)
            pass_from = upto
    if len(hashes):
        long_rows = {r for r, _ in hashes}
    else:
        long_rows = set()
    pieces: dict[int, list[np.ndarray]] = {}
    for row, h in hashes:
        pieces.setdefault(row, []).append(h)
    out: list[np.ndarray] = []
    for first, end in segments(offsets):
        if first in long_rows and end == first + 1:
            out.extend(pieces[first])
            continue
        base, stop = int(offsets[first]), int(offsets[end])
        cuts = (offsets[first + 1 : end] - base).astype(np.int64)
        block = np.insert(fold[data[base:stop]], cuts, 32)
        starts, h = _hash_block(block, is_word)
        begins = (offsets[first:end] - base) + np.arange(end - first)
        index = np.searchsorted(starts, begins)
        counts[first:end] = np.diff(np.append(index, len(h)))
        out.append(h)
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=at[1:])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), at
