"""The context of documents over a stream that is stopped and started again, and that forgets quiet documents."""

import datetime
import random

from lectern.streaming import context

KIND = "ts timestamp, doc_id long, chunk_idx int, seq int, speaker string"
START = datetime.datetime(2024, 1, 1)


def run(spark, source, folder, name, **more):
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(source))
    sink = f"{source}-{name}"
    keep = lambda df, _: df.write.mode("append").parquet(sink)
    query = context.track_context(stream, **more).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(100)
    finally:
        query.stop()
    return spark.read.parquet(sink).collect()


def plain(rows):
    known, active = [], []
    for *_, name in rows:
        if name and name not in ("旁白", "UNKNOWN"):
            known += [name] if name not in known else []
            active = [name, *[a for a in active if a != name]][:3]
    return max(r[2] for r in rows) + 1, known, active


def test_a_restart_goes_on_where_the_stream_stopped(spark, tmp_path):
    rng, rows = random.Random(3), []
    for part in range(3):
        rows.append([(START + datetime.timedelta(minutes=part), d, part, s, rng.choice(["甲", "乙", "丙", "丁", "旁白", "UNKNOWN", None])) for d in range(6) for s in range(rng.randrange(1, 6))])
    source, folder, last = tmp_path / "in", tmp_path / "ck", {}
    for k, made in enumerate(rows):
        rng.shuffle(made)
        spark.createDataFrame(made, KIND).coalesce(1).write.mode("append").parquet(str(source))
        for r in run(spark, source, folder, f"part{k}"):
            last[r.doc_id] = (r.chunks, r.known, r.active)
            assert not r.closed
    whole = sorted((r for made in rows for r in made), key=lambda r: r[1:4])
    assert last == {d: plain([r for r in whole if r[1] == d]) for d in range(6)}


def test_quiet_documents_are_closed_and_forgotten(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "ck"
    hour = lambda h: START + datetime.timedelta(hours=h)
    seen = []
    for k, rows in enumerate([[(hour(0), 1, 0, 1, "甲"), (hour(0), 2, 0, 1, "乙")], [(hour(5), 2, 1, 1, "丙")], [(hour(6), 1, 7, 1, "丁")]]):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(source))
        seen.append(sorted((r.doc_id, r.chunks, tuple(r.known), r.closed) for r in run(spark, source, folder, f"quiet{k}", idle_seconds=3 * 3600)))
    assert seen[0] == [(1, 1, ("甲",), False), (2, 1, ("乙",), False)]
    told = [r for part in seen[1:] for r in part]
    assert (1, 1, ("甲",), True) in told and (2, 2, ("乙", "丙"), False) in told
    # what comes after the end is a new document
    assert (1, 8, ("丁",), False) in told
