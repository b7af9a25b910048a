"""Queries over the prose adapter read whole turns."""

import duckdb
from test_catalogue import TABLES

from lectern.plans import adapters as A


def test_lines_hold_the_whole_turn(spark, sf):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = {(r[0], r[1]): r[2] or "" for r in duck.sql("select conv_id, turn, text from conversations where conv_id is not null and turn is not null").fetchall()}
    got = A.conversation_lines(spark, sf).collect()
    flat = lambda t: t.replace("\r", "\n").replace("\n", " ")
    assert any(len(t) > 120 for t in want.values()) and len(got) == len(want)
    assert all(flat(want[r.doc_id, r.turn]) in r.line for r in got)
