"""WARC archives of pages and a globally ordered capture index over them.

write_archives() writes one record a page with Spark's own text writer (a record is text, the record end is the line
end) into files of bounded bytes, each a capture run sorted by (URL key, time, page). read_archives() parses the files by
their lengths. merge_index() cuts the index into ranges of bounded size; in each a k-way loser tree merges the runs of all
files, as they stand in the files, into global order.

Defined results
* null html is an empty payload; of equal payloads of at least `least` bytes the smallest page_id is the response, the
  others are revisits that refer to it; smaller payloads are always responses;
* rows with the smallest page_id that are repeated are all responses; rows with a null page_id are always responses;
* pages carry no time: a page's capture time is EPOCH plus its page_id in seconds, modulo ten years (a null id: EPOCH), in
  UTC whatever the session's zone;
* a null url has an empty key; white space and control characters of urls are left out of the header;
* an empty table writes no record and gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, materialize, scratch_path

LEAST_BYTES = 100
#: (payload bytes below, records a file): files hold some 64 MB at most, or one record.
SIZE_CLASSES = ((32 << 10, 2000), (1 << 20, 64), (1 << 62, 1))
EPOCH, SPAN = 1_700_000_000, 10 * 365 * 86_400
#: So many digests (about 10 MB) may be broadcast.
BROADCAST_DIGESTS = 100_000
#: Pages with one digest are dealt over so many tasks where digests are not broadcast.
SALTS = 32
#: Index entries of a range, which one task merges.
RANGE_ENTRIES = 200_000
_END = "\r\n\r\n"
INDEX = "url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, record_offset long, record_length long"


def url_key(url):
    """Sort-friendly key: reversed host, then path and query; scheme, port and `www.` are left out."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def captures(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, refers_to.

    Only (digest, page_id) is aggregated, combined before the shuffle. Digests that occur twice are broadcast if their count
    allows it, so payloads stay where they are. Beyond, only ids and digests meet, dealt by salt, and payloads are then
    shuffled once by page, so a digest that many pages share makes no hot task.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "n_bytes": F.octet_length("payload").cast("long")})
    shared = base.where((F.col("n_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id")
    shared = materialize(shared, "archive-shared")
    if shared.count() <= BROADCAST_DIGESTS:
        return base.join(F.broadcast(shared), "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))).drop("first_id")
    ids = base.where("page_id is not null").select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    first = shared.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    revisits = ids.join(first, ["digest", "salt"]).where("page_id > first_id").select("page_id", "digest", F.col("first_id").alias("refers_to")).distinct()
    return base.join(revisits, ["page_id", "digest"], "left").select("digest", "page_id", "url", "payload", "n_bytes", "refers_to")


def _captured(page_id):
    """yyyy-mm-ddThh:mm:ssZ by whole days and seconds, so no session zone has a part in it."""
    seconds = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(SPAN)) + EPOCH
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86_400))
    return F.concat(day, F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.pmod(F.floor(rest / 60), F.lit(60)), F.pmod(rest, F.lit(60))))


def _record():
    revisit = F.col("refers_to").isNotNull()
    date = F.col("captured")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(_END))
    body = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Date: "), date, F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body,
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES, classes=SIZE_CLASSES) -> None:
    """WARC files under path, each a capture run sorted by URL key, time and page. Retried tasks leave no partial file.

    Pages are written by size class, as the text writer bounds a file by records only; a class without pages costs no pass.
    """
    rows = captures(pages, least).withColumns({"key": url_key(F.col("url")), "captured": _captured(F.col("page_id"))})
    size = F.octet_length(F.coalesce(pages["html"], F.lit("")))
    bounds = [0, *[limit for limit, _ in classes]]
    counts = pages.agg(*[F.count_if((size >= low) & (size < high)).alias(f"c{i}") for i, (low, high) in enumerate(zip(bounds, bounds[1:]))]).first()
    for i, (low, (high, per_file)) in enumerate(zip(bounds, classes)):
        if counts[i]:
            some = rows.where((F.col("n_bytes") >= low) & (F.col("n_bytes") < high)).sortWithinPartitions("key", "captured", F.col("page_id").asc_nulls_first())
            some.select(_record().alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", per_file).text(f"{path}/size={i}")
    if not any(counts):
        rows.limit(0).select(_record().alias("value")).write.text(f"{path}/size=0")


def parse(content: bytes):
    """Records of one archive: (headers, block, offset, length); lengths decide, whatever the payloads hold."""
    at = 0
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        lines = content[at:head].split(b"\r\n")
        headers = dict(x.split(b": ", 1) if b": " in x else (x.rstrip(b":"), b"") for x in lines[1:])
        size = int(headers[b"Content-Length"])
        yield headers, content[head + 4 : head + 4 + size], at, head + 8 + size - at
        at = head + 8 + size


def _page(urn: bytes):
    digits = urn.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(digits) if digits else None


def _entries(batches):
    import pyarrow as pa

    names = ["url", "captured", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive", "record_offset", "record_length"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            rows = []
            for headers, block, offset, length in parse(content.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                stated = headers[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode()
                kind, refers = headers[b"WARC-Type"].decode(), headers.get(b"WARC-Refers-To")
                if kind == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if digest != stated:
                        raise ValueError(f"payload digest differs in {path} at {offset}")
                else:
                    size, digest = int(http.rpartition(b"Content-Length: ")[2]), stated
                rows.append((headers[b"WARC-Target-URI"].decode(), headers[b"WARC-Date"].decode(), _page(headers[b"WARC-Record-ID"]), kind, _page(refers) if refers else None, size, digest, path.as_py().rpartition("/")[2], offset, length))
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all archives under path, with sizes and digests of the payloads as read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    got = files.mapInArrow(_entries, INDEX.replace("url_key string", "url string"))
    return got.withColumn("url_key", url_key(F.col("url"))).drop("url")


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so each output costs log2(k) comparisons."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        k = self.size = len(self.heads)
        self.losers = [0] * max(1, k)
        winner = [0] * (2 * k)
        for i in range(k):
            winner[k + i] = i
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winner[1] if k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self):
        while self.size and self.heads[self.winner] is not None:
            w = self.winner
            yield w, self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.size) // 2
            while node >= 1:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def _merge(batches):
    """The runs of one range, a file's entries one after another, merged."""
    import numpy as np
    import pyarrow as pa

    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return
    archive = table.column("archive").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.append(True, archive[1:] != archive[:-1])).tolist() + [table.num_rows]
    keys, times, pages = table.column("url_key"), table.column("captured"), table.column("page_id")

    def run(first: int, end: int, rows: int = 1024):
        """A run's keys, some rows at a time; a run out of order would break the merge, so it is an error."""
        before = None
        for at in range(first, end, rows):
            n = min(rows, end - at)
            for i, key in enumerate(zip(keys.slice(at, n).to_pylist(), times.slice(at, n).to_pylist(), (_FIRST if x is None else x for x in pages.slice(at, n).to_pylist()))):
                if before is not None and key < before:
                    raise ValueError(f"archive {archive[first]} is not sorted")
                before = key
                yield *key, at + i

    order = np.fromiter((key[3] for _, key in LoserTree([run(a, b) for a, b in zip(cuts, cuts[1:])])), np.int64, table.num_rows)
    yield from table.take(pa.array(order)).to_batches(max_chunksize=10_000)


_FIRST = -(1 << 63)


def merge_index(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """Index entries in global order of URL key, timestamp and page over the partitions of the result.

    Ranges are cut on (key, time, page), so a hot host, or even a hot URL, is dealt over many tasks, and there are as many as
    keep a range at about RANGE_ENTRIES, whatever the size of the index. In a range the entries of a file come in the file's
    own order; only the loser tree orders files against each other.
    """
    spark = index.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE_ENTRIES))
    dealt = index.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "record_offset").sortWithinPartitions("archive", "record_offset")
    return dealt.select(*[c.split()[0] for c in INDEX.split(", ")]).mapInArrow(_merge, INDEX)


def capture_history(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write the archives to the shared folder, read them back and merge their index; the archives go once they are read."""
    spark = pages.sparkSession
    path = scratch_path(spark, "archives")
    write_archives(pages, path, least)
    index = materialize(read_archives(spark, path), "archive-index")
    discard(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return merge_index(index)
