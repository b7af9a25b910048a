"""Clips by their chunks, and the dated layout written twice."""

import struct

from pyspark.sql import functions as F

from lectern.operators import codecs, segments, splitting
from lectern.sources import io


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def clip(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def form(channels=2, rate=8000, bits=16):
    return chunk(b"fmt ", struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits))


def test_clips_are_walked_chunk_by_chunk(spark, tmp_path):
    data = chunk(b"data", b"\1" * 32_000)
    files = {
        "plain": (clip(form(), data), (2, 8000, 8000, 1.0)),
        "list": (clip(form(), chunk(b"LIST", b"x" * 10_240), chunk(b"odd ", b"y" * 333), data), (2, 8000, 8000, 1.0)),
        "many": (clip(*[chunk(b"note", b"data" + bytes([i])) for i in range(100)], form(1), data), (1, 8000, 16_000, 2.0)),
        "early": (clip(data, form()), (2, 8000, 8000, 1.0)),
        "short": (clip(form(), data)[:-16_000], (2, 8000, 4000, 0.5)),
        "silent": (clip(form(2, 0), data), (2, 0, 8000, 0.0)),
        "empty": (clip(form()), (2, 8000, 0, 0.0)),
        "eight": (clip(form(1, 4000, 8), chunk(b"data", b"z" * 4001)), (1, 4000, 4001, 4001 / 4000)),
        "junk": (b"no clip at all, fmt data", (None, None, 0, 0.0)),
        "cut": (clip(form())[:20], (None, None, 0, 0.0)),
    }
    for name, (raw, _) in files.items():
        (tmp_path / f"{name}.wav").write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1][:-4]: (r.channels, r.sample_rate, r.frames, r.duration) for r in io.wav_metadata(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {name: want for name, (_, want) in files.items()}


def test_empty_and_missing_contents(spark):
    rows = spark.createDataFrame([("a", b""), ("b", None)], "path string, content binary")
    assert sorted(tuple(r) for r in io.wav_metadata(rows).select("path", "frames", "duration").collect()) == [("a", 0, 0.0), ("b", 0, 0.0)]


def test_a_rerun_replaces_its_day_only(spark, tmp_path):
    kind = "day string, name string, category string, size int"
    first = [("2024-01-01", "preview_a", None, 1), ("2024-01-01", "book", "wav", 2), ("2024-01-02", "Preview_b", "my cat/1", 3)]
    path = str(tmp_path / "arc")
    for _ in range(2):
        io.write_archive(io.archive_layout(spark.createDataFrame(first, kind)), path)
    rows = lambda: sorted((r.area, str(r.day), r.category, r.name, r.size) for r in spark.read.parquet(path).collect())
    assert rows() == [("outputs", "2024-01-01", "wav", "book", 2), ("temp_by_date", "2024-01-01", "preview", "preview_a", 1), ("temp_by_date", "2024-01-02", "my_cat_1", "Preview_b", 3)]
    io.write_archive(io.archive_layout(spark.createDataFrame([("2024-01-01", "book", "wav", 9)], kind)), path)
    assert [r[4] for r in rows()] == [9, 1, 3]


def test_plans_and_slices_cut_long_chunks(spark):
    text = "\n".join(f"第{i}行" + "文" * 90 for i in range(400))
    chunks = spark.createDataFrame([(1, 0, "t", text), (2, 0, "t", ""), (3, 0, "t", None)], "doc_id long, chunk_idx int, title string, content string")
    slices = splitting.line_slices(chunks, 900, 12).orderBy("part").collect()
    assert "\n".join(r.content for r in slices) == text and slices[0].line_ids[0] == "L1" and {r.doc_id for r in slices} == {1}
    lines = splitting.number_lines(chunks.select("doc_id", "chunk_idx", "content"))
    plan = "CHUNKS:\nL1-L150 | 甲\nL151-L390\nL391-L9999 | 丙"
    got = codecs.decode_chunk_plan(chunks.where("doc_id = 1").withColumn("response", F.lit(plan)), lines).orderBy("part_no").collect()
    assert [(r.part_no, r.title, r.ok) for r in got] == [(1, "甲", True), (2, "第2块", True), (3, "丙", True)] and "\n".join(r.content for r in got) == text
    bad = codecs.decode_chunk_plan(chunks.where("doc_id = 1").withColumn("response", F.lit("CHUNKS:\nL0-L2 | x\nL500 | y")), lines).orderBy("part_no").collect()
    assert [(r.content, r.ok) for r in bad] == [(None, False), (None, False)]


def test_names_missing_from_the_source(spark):
    docs = spark.createDataFrame([(1, "甲来了"), (2, ""), (3, None)], "doc_id long, text string")
    segs = spark.createDataFrame([(1, 1, "甲"), (1, 2, "乙"), (1, 3, "旁白"), (2, 1, "丙"), (3, 1, "丁"), (9, 1, "戊")], "doc_id long, seq int, speaker string")
    got = {(r.doc_id, r.seq): (r.review_reason, r.needs_review) for r in segments.mark_missing_from_source(segs, docs).collect()}
    assert got == {(1, 1): (None, False), (1, 2): ("speaker_missing_from_source", True), (1, 3): (None, False), (2, 1): (None, False), (3, 1): (None, False), (9, 1): (None, False)}
