"""Threads by arrival: orders, late parents, messages that join threads, repeats."""

from datetime import datetime

from faultlens.operators.threads import Threads

DAY = lambda n: datetime(2024, 1, n)
MAIL = [
    ("m1", None, DAY(1)), ("m2", ["m1"], DAY(3)), ("m3", ["m2"], None), ("m4", ["gone"], DAY(9)), ("m5", ["gone", None], DAY(2)), ("m6", [], DAY(4)), ("m7", ["m3", "m4"], DAY(5)), ("m8", ["m8"], None), ("a0", ["m6"], DAY(7)),
]
# m7 joins m1..m3 with m4, m5 through the message that never came; a0 names its thread
WANT = {("gone", 6, DAY(1), DAY(9)), ("a0", 2, DAY(4), DAY(7)), ("m8", 1, None, None)}


def test_orders_of_arrival_give_the_same_threads(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    frame = lambda rows: spark.createDataFrame([*rows, (None, ["m1"], None)], "id string, refs array<string>, date timestamp").coalesce(1)
    try:
        for nth, order in enumerate(([MAIL], [MAIL[6:], MAIL[:3], MAIL[3:6]], [MAIL[:6:2], [*MAIL[1:6:2], MAIL[0]], [MAIL[8], MAIL[7]], [MAIL[6]]])):
            threads = Threads(spark, f"file://{tmp_path}/{nth}")
            for batch, rows in enumerate(order):
                threads.add(batch, frame(rows))
            threads.add(0, frame(MAIL))  # known already
            assert {tuple(r) for r in threads.summary().collect()} == WANT
        assert {(r["id"], r["thread"]) for r in threads.members().collect()} == {(m, "gone") for m in ("m1", "m2", "m3", "m4", "m5", "m7")} | {("m6", "a0"), ("a0", "a0"), ("m8", "m8")}
        assert Threads(spark, f"file://{tmp_path}/none").summary().collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
