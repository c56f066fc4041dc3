import base64
import hashlib
import random
import zlib
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from faultlens.llm import queries, warc

SF = "/root/testdata/sf0.001"


def plain(rows, min_bytes=0):
    """By a dictionary: of equal payloads the smallest page_id is the response."""
    head = {}
    for page_id, _, html in rows:
        p = (html or "").encode()
        if page_id is not None and len(p) >= min_bytes:
            head[p] = min(page_id, head.get(p, page_id))
    out = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = head.get(p)
        revisit = first is not None and page_id != first
        out.append((page_id, len(p), digest, "revisit" if revisit else "response", first if revisit else None))
    return out


def pages(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = [(i, f"http://{rng.choice(['a.com', 'www.B.org:80', 'c.net'])}/{rng.randrange(30)}", rng.choice(["<p>same</p>", "", None, f"<p>{i} \u00e9</p>"])) for i in range(n)]
    rows += [(None, "http://a.com/1", "<p>same</p>"), (None, None, "only without a number"), (7, "http://a.com/x y\n", "twice"), (7, "http://a.com/x y\n", "twice"), (-3, None, "x" * 300_000)]
    return rows, spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, uri string").repartition(5)


SECONDS = "timestamp_seconds(coalesce(page_id, 0) + 1000)"
COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("sizes", [{}, {"run_entries": 9, "block_entries": 4, "fan_in": 3, "range_entries": 20}, {"run_entries": 30, "block_entries": 1, "fan_in": 2, "range_entries": 7}])
def test_histories_come_out_whole_and_in_order(spark, sizes):
    rows, table = pages(spark)
    _, manifest = warc.write(table, F.expr(SECONDS), file_bytes=4000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 5
    found = sorted((tuple(r) for r in warc.histories(spark, manifest, **sizes).select("part", "nth", "url_key", "captured", *COLUMNS).collect()), key=lambda r: r[:2])
    assert [r[2:4] for r in found] == sorted(r[2:4] for r in found)
    assert sorted((r[4:] for r in found), key=str) == sorted(plain(rows), key=str)
    assert all(r[3] == datetime.fromtimestamp(1000 + (r[4] or 0)) for r in found)


def test_payloads_below_the_minimum_are_stored_and_records_are_read_from_their_places(spark):
    rows, table = pages(spark, 60)
    _, manifest = warc.write(table, F.expr(SECONDS), min_bytes=5)
    found = warc.histories(spark, manifest)
    assert sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str) == sorted(plain(rows, 5), key=str)
    got = sorted(((r["page_id"], r["record_type"], bytes(r["content"])) for r in warc.fetch(found).collect()), key=str)
    assert got == sorted(((i, kind, (html or "").encode() if kind == "response" else b"") for (i, _, html), (_, _, _, kind, _) in zip(rows, plain(rows, 5), strict=True)), key=str)


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    _, manifest = warc.write(empty, F.expr(SECONDS))
    assert warc.histories(spark, manifest).collect() == []
    with pytest.raises(TypeError, match="integer"):
        warc.write(spark.createDataFrame([], "page_id string, url string, html string"), F.expr(SECONDS))


def test_loser_tree_merges_like_sorting():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        for _ in range(30):
            streams = [sorted((bytes([rng.randrange(20)]), bytes([s])) for _ in range(rng.randrange(9))) for s in range(k)]
            merged = list(warc.LoserTree([iter(s) for s in streams]))
            assert merged == sorted((e for s in streams for e in s), key=lambda e: (e[0], e[1]))


def test_records_and_keys(tmp_path):
    when = datetime(2001, 2, 3, 4, 5, 6)
    raw = zlib.decompress(warc.record(9, "http://x.org/a b", when, b"<p>", None, True), 31)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://x.org/a%20b\r\n" in raw and raw.endswith(b"\r\n\r\n<p>\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        warc._capture(raw.replace(b"<p>", b"<q>"))
    with pytest.raises(ValueError, match="damaged"):
        warc._capture(raw[:-1])
    assert [warc.url_key(u) for u in ("HTTP://www.B.org:80/Path?Q=1#f", "a.b.com", "https://u@h.de:8443", None, "")] == ["org,b)/path?q=1", "com,b,a)/", "de,h:8443)/", "", ""]
    place = tmp_path / "cut.warc.gz"
    place.write_bytes(warc.record(9, None, when, b"<p>", None, True)[:-3])
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records(f"file://{place}"))


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.oracle_sql()['op12_index_merge']})").fetchall()
    assert sorted((tuple(r) for r in queries.op12_index_merge(spark, SF).select(*COLUMNS).collect()), key=str) == sorted(want, key=str)
