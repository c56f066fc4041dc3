"""WARC archives of captured pages, and their index, merged from sorted runs into one global order.

Writing: equal payloads are found by their SHA-256; of each group the smallest page_id is stored as `response`, the others
as `revisit` records that name it (payloads below min_bytes are always stored). Every task writes its own archive
files, each record a gzip member of its own, so a record can be read from its offset. Repeats of a popular payload are
dealt over salted copies of its group's row, no task gets all of them.

Indexing, an external merge sort:
1. Archives are read whole, file by file. Digests and lengths of stored payloads are computed anew and compared with the
   headers. Up to `run_entries` captures are sorted in memory by (URL key, timestamp, page_id, file, offset) and written
   as a run: compressed blocks of `block_entries`, and for each block a row with its place, first and last key.
2. Runs are merged `fan_in` at a time by a loser tree, in as many passes as that takes. Work is divided into key
   ranges, whose split points come from a bounded sample of the blocks' first keys (only the balance depends on it; a key
   holds the page_id and the place, so that one URL may be cut as well). A task holds one block of each run.
3. The last pass returns the captures as rows, ordered within numbered ranges; ranges are in order.

Results: a null payload is an empty one; a null URL has the empty key; rows that repeat a page_id are captures of their
own, and those that repeat the smallest of a group are all responses; a null page_id is never referred to, and a
response only where its group has no other. Payload text is written as UTF-8. Characters up to U+0020 in URLs are
percent-encoded. No pages give no captures. Columns that are not named are not read. A record is held in memory whole.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from faultlens.llm.files import Input, Output
from faultlens.llm.shared import by_bytes, delete, joined_hot, new_folder, partitions, stored, trimmed

STEP = 4 << 20
FILE_BYTES = 256 << 20
RUN_ENTRIES = 50_000
BLOCK_ENTRIES = 256
FAN_IN = 64
RANGE_ENTRIES = 200_000
MOST_RANGES = 20_000
SAMPLED = 100_000
POINT_BYTES = 256

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:page:{}>"


# --- records


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def url_key(url: str | None) -> str:
    """Sort-friendly form: host parts from the last to the first, then port, path and query; in lower case."""
    if not url:
        return ""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", _uri(url.strip()).lower())
    host, slash, path = re.match(r"([^/?#]*)(/?)(.*)$", rest, re.S).groups()
    name, _, port = host.rpartition("@")[2].partition(":")
    port = "" if port in ("", "80", "443") else f":{port}"
    name = re.sub(r"^www\d*\.", "", name)
    return f"{','.join(reversed(name.split('.')))}{port}){slash or '/'}{path.partition('#')[0]}"


def record(page_id: int | None, url: str | None, captured: datetime, payload: bytes, refers_to: int | None, stored_whole: bool) -> bytes:
    """One gzip member with a response record, or a revisit record without payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if stored_whole else 'revisit'}", f"WARC-Record-ID: {_ID.format('' if page_id is None else page_id)}"]
    head.append(f"WARC-Date: {captured.isoformat()}Z")
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if not stored_whole:
        head += [f"WARC-Refers-To: {_ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    body = http + payload if stored_whole else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + made.flush()


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, HTTP head, payload) of one record; ValueError where it is damaged."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or not gap or rest[length:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return fields, http, payload


def _number(said: str | None) -> int | None:
    inner = (said or "")[len(_ID) - 3 : -1]
    return int(inner) if inner else None


def _capture(raw: bytes) -> dict:
    """What the index says of a record."""
    fields, http, payload = parsed(raw)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload differs from its digest")
    return {
        "page_id": _number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "captured": fields["WARC-Date"][:-1],
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _number(fields.get("WARC-Refers-To")),
    }


def records(uri: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every gzip member of an archive, in order, in steps of STEP bytes."""
    file = Input(uri)
    try:
        at, start, parts, inflate, data = 0, 0, [], zlib.decompressobj(31), b""
        while True:
            if not data:
                data = file.read(at, STEP)
                if not data:
                    break
                at += len(data)
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
            if inflate.eof:
                end = at - len(data)
                yield start, end - start, b"".join(parts)
                start, parts, inflate = end, [], zlib.decompressobj(31)
        if start != at:
            raise ValueError(f"{uri} ends within a record")
    finally:
        file.close()


# --- writing


def write(pages: DataFrame, captured: Column, min_bytes: int = 0, folder: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Writes pages (page_id, url, html) as archives; (folder, manifest with uri and records of each file). captured:
    the time of each page's capture."""
    spark = pages.sparkSession
    if not isinstance(pages.schema["page_id"].dataType, IntegralType):
        raise TypeError("page_id has to be of an integer type")
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), captured.cast("timestamp").alias("captured"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    groups = keyed.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    whole = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    named = joined_hot(keyed, groups, "digest").select("page_id", "url", "html", F.date_format(F.to_utc_timestamp("captured", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("captured"), "first", whole.alias("whole"))

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, out, n = TaskContext.get().partitionId(), 0, None, 0
        rows: list[tuple[str, int]] = []
        for batch in by_bytes(batches, "html", STEP):
            for page_id, url, html, when, first, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and out.size >= file_bytes:
                    out.close()
                    rows.append((out.path, n))
                    out = None
                if out is None:  # named by the task: one that runs again writes the same files
                    out, n, nth = Output(f"{folder}/part-{task:06d}-{nth:04d}.warc.gz"), 0, nth + 1
                out.write(record(page_id, url, datetime.fromisoformat(when), html.encode(), first, whole))
                n += 1
        if out is not None:
            out.close()
            rows.append((out.path, n))
        uris = [f"{folder}/{path.rpartition('/')[2]}" for path, _ in rows]
        yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array([k for _, k in rows], pa.int64())], ["uri", "records"])

    manifest, _ = stored(named.mapInArrow(run, "uri string, records long"), "warc-files")
    return folder, manifest


# --- sorted runs


def _order(key: str, captured: str, page_id: int | None, uri: str, offset: int) -> bytes:
    """Bytes that sort like (key, captured, page_id with null first, uri, offset)."""
    number = 0 if page_id is None else page_id + (1 << 63) + 1
    return b"\0".join((key.encode(), captured.encode(), b"%020d" % number, uri.encode(), b"%016d" % offset))


_BLOCK_ROW = "run long, block long, uri string, offset long, length long, n long, first binary, last binary"
_BLOCK_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())


class _RunWriter:
    """A file of blocks of entries in ascending order; rows has one tuple for each block."""

    def __init__(self, uri: str, run: int, block: int, block_entries: int) -> None:
        self.uri, self.run, self.block, self.most = uri, run, block, block_entries
        self.out, self.held, self.rows = Output(uri), [], []

    def add(self, order: bytes, said: bytes) -> None:
        self.held.append((order, said))
        if len(self.held) == self.most:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            data = zlib.compress(b"".join(len(o).to_bytes(4, "little") + len(s).to_bytes(4, "little") + o + s for o, s in self.held), 1)
            self.rows.append((self.run, self.block, self.uri, self.out.size, len(data), len(self.held), self.held[0][0], self.held[-1][0]))
            self.out.write(data)
            self.block, self.held = self.block + 1, []

    def close(self) -> pa.RecordBatch:
        self._flush()
        self.out.close()
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * len(_BLOCK_KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _BLOCK_KINDS, strict=True)], [f.split()[0] for f in _BLOCK_ROW.split(", ")])


def _entries(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    data, at = zlib.decompress(data), 0
    while at < len(data):
        a, b = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8
        yield data[at : at + a], data[at + a : at + a + b]
        at += a + b


def _sorted_runs(manifest: DataFrame, folder: str, run_entries: int, block_entries: int) -> DataFrame:
    """Block rows of the sorted runs of all archives."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, held = TaskContext.get().partitionId(), 0, []

        def written() -> pa.RecordBatch:
            out = _RunWriter(f"{folder}/run-{task:06d}-{nth:05d}.idx", task << 24 | nth, 0, block_entries)
            for entry in sorted(held):
                out.add(*entry)
            return out.close()

        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                for offset, length, raw in records(uri):
                    found = _capture(raw) | {"uri": uri, "offset": offset, "length": length}
                    found["url_key"] = url_key(found["url"])
                    held.append((_order(found["url_key"], found["captured"], found["page_id"], uri, offset), json.dumps(found).encode()))
                    if len(held) == run_entries:
                        yield written()
                        held, nth = [], nth + 1
        if held:
            yield written()

    return manifest.select("uri").repartition(partitions(manifest.sparkSession), "uri").mapInArrow(run, _BLOCK_ROW)


# --- merging


class LoserTree:
    """Merges ascending streams of (order, value). Inner node i keeps the stream that lost the match played there, node 0
    the winner; when the winner moves on, only the matches on its path are played again. Of equal orders the earlier
    stream comes first."""

    def __init__(self, streams: list[Iterator[tuple[bytes, bytes]]]) -> None:
        self.streams = [iter(s) for s in streams]
        self.k = len(self.streams)
        self.values: list[bytes | None] = [None] * self.k
        self.heads: list[tuple] = [()] * self.k
        for leaf in range(self.k):
            self._advance(leaf)
        winners = [*([-1] * self.k), *range(self.k)]
        self.losers = [-1] * max(1, self.k)
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.losers[0] = winners[1] if self.k > 1 else self.k - 1

    def _advance(self, leaf: int) -> None:
        order, self.values[leaf] = next(self.streams[leaf], (None, None))
        self.heads[leaf] = (1, b"", leaf) if order is None else (0, order, leaf)

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        heads, losers, k = self.heads, self.losers, self.k
        while k:
            leaf = losers[0]
            if heads[leaf][0]:
                return
            yield heads[leaf][1], self.values[leaf]
            self._advance(leaf)
            node = (leaf + k) >> 1
            while node:
                if heads[losers[node]] < heads[leaf]:
                    losers[node], leaf = leaf, losers[node]
                node >>= 1
            losers[0] = leaf


def _points(blocks: DataFrame, n_ranges: int) -> list[bytes]:
    """At most n_ranges - 1 ascending keys that cut the blocks into about equal parts, from at most some SAMPLED of them."""
    total = blocks.count()
    if n_ranges < 2 or not total:
        return []
    chosen = blocks.where(F.pmod(F.xxhash64("run", "block"), F.lit(-(-total // SAMPLED))) == 0)
    firsts = sorted(bytes(r[0]) for r in chosen.select(F.substring("first", 1, POINT_BYTES)).collect())
    return sorted({firsts[len(firsts) * i // n_ranges] for i in range(1, n_ranges)} if firsts else set())


def _merge(blocks: DataFrame, fan_in: int, range_entries: int, finish: Callable, schema: str) -> DataFrame:
    """Merges groups of fan_in neighbouring runs, a key range at a time. finish(group, range, merged entries) yields
    batches. blocks: run is numbered from 0."""
    spark = blocks.sparkSession
    total, runs = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("run"), F.lit(0)) + 1).first()
    groups = -(-runs // fan_in)
    points = _points(blocks, max(1, min(MOST_RANGES, -(-total // groups // range_entries))))
    shared = spark.sparkContext.broadcast(points)  # MOST_RANGES keys of POINT_BYTES at most

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(c).to_pylist() for c in ("first", "last"))
            part = [range(bisect.bisect_right(shared.value, a), bisect.bisect_right(shared.value, b) + 1) for a, b in zip(first, last, strict=True)]
            rows = batch.take(pa.array([k for k, own in enumerate(part) for _ in own], pa.int64()))
            yield rows.append_column("part", pa.array([p for own in part for p in own], pa.int32()))

    @trimmed
    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("group", "part", "run", "uri", "offset", "length")
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for (group, part), own in groupby(rows, key=itemgetter(0, 1)):
            low = shared.value[part - 1] if part else b""
            high = shared.value[part] if part < len(shared.value) else None
            files: dict[str, Input] = {}

            def stream(places: list, files=files, low=low, high=high) -> Iterator[tuple[bytes, bytes]]:
                for uri, offset, length in places:
                    if uri not in files:
                        files[uri] = Input(uri)
                    for order, said in _entries(files[uri].read(offset, length)):
                        if order >= low and (high is None or order < high):
                            yield order, said

            places = [[row[3:] for row in of_run] for _, of_run in groupby(list(own), key=itemgetter(2))]
            yield from finish(group, part, LoserTree([stream(p) for p in places]))
            for file in files.values():
                file.close()

    spread = blocks.mapInArrow(dealt, f"{_BLOCK_ROW}, part int").withColumn("group", F.floor(F.col("run") / fan_in))
    ordered = spread.repartition(partitions(spark), "group", "part").sortWithinPartitions("group", "part", "run", "block")
    return ordered.mapInArrow(merged, schema)


_CAPTURE = {
    "part": pa.int32(), "nth": pa.int64(), "url_key": pa.string(), "captured": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "uri": pa.string(), "offset": pa.int64(), "length": pa.int64(),
}


def histories(
    spark: SparkSession, manifest: DataFrame, run_entries: int = RUN_ENTRIES, block_entries: int = BLOCK_ENTRIES, fan_in: int = FAN_IN, range_entries: int = RANGE_ENTRIES
) -> DataFrame:
    """The captures of all archives in the order of URL key and timestamp: part and nth number them (nth within part).
    With the place of their record (uri, offset, length)."""
    folder = new_folder(spark, "warc-index")
    blocks, place = stored(_sorted_runs(manifest, folder, run_entries, block_entries), "warc-blocks")
    # runs are numbered without gaps by a bounded number of tasks and their counters
    ids = blocks.select("run").distinct()
    per_task = {r[0]: r[1] for r in ids.groupBy(F.shiftright("run", 24)).agg(F.max(F.col("run").bitwiseAND(0xFFFFFF)) + 1).collect()}
    base, n = {}, 0
    for task in sorted(per_task):
        base[task], n = n, n + per_task[task]
    names = spark.createDataFrame(list(base.items()), "task long, base long")
    blocks = blocks.withColumn("task", F.shiftright("run", 24)).join(F.broadcast(names), "task").withColumn("run", F.col("base") + F.col("run").bitwiseAND(0xFFFFFF)).drop("task", "base")
    turn = 0
    while n > fan_in:
        turn += 1

        def to_file(group: int, part: int, entries: Iterable[tuple[bytes, bytes]], turn=turn) -> Iterator[pa.RecordBatch]:
            out = _RunWriter(f"{folder}/pass-{turn}-{group:06d}-{part:05d}.idx", group, part << 32, block_entries)
            for order, said in entries:
                out.add(order, said)
            yield out.close()

        blocks, new_place = stored(_merge(blocks, fan_in, range_entries, to_file, _BLOCK_ROW), "warc-blocks")
        delete(spark, place)
        place, n = new_place, -(-n // fan_in)

    def to_rows(group: int, part: int, entries: Iterable[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        held, nth = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(held, pa.schema(_CAPTURE))

        for _, said in entries:
            held.append({**json.loads(said), "part": part, "nth": nth})
            nth += 1
            if len(held) == 2000:
                yield made()
                held.clear()
        yield made()

    text = ("url_key", "captured", "url", "payload_digest", "record_type", "uri")
    schema = ", ".join(f"{c} {'string' if c in text else 'int' if c == 'part' else 'long'}" for c in _CAPTURE)
    return _merge(blocks, fan_in, range_entries, to_rows, schema).withColumn("captured", F.to_timestamp(F.concat("captured", F.lit("Z"))))


def fetch(captures: DataFrame) -> DataFrame:
    """page_id, record_type, content (the payload as stored; empty for a revisit) of captures, each read from its place."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, kind, uri, offset, length in zip(*(batch.column(c).to_pylist() for c in ("page_id", "record_type", "uri", "offset", "length")), strict=True):
                file = Input(uri)
                content = parsed(zlib.decompress(file.read(offset, length), 31))[2]
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array([page_id], pa.int64()), pa.array([kind]), pa.array([content], pa.binary())], ["page_id", "record_type", "content"])

    return captures.mapInArrow(run, "page_id long, record_type string, content binary")
