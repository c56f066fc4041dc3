"""Files that tasks read in parts, by the data source API: mailboxes by byte ranges, dated logs newest first.

Bytes are kept as they are; decoding is left to the parser. Paths are local files or URIs of stores that pyarrow knows.
"""

from __future__ import annotations

import datetime
import heapq
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 20
START = b"\nFrom "


def _files(path: str) -> list[tuple[str, int]]:
    """(uri or path, size) of a file, or of all files below a folder, by name; hidden ones are left out."""
    store, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{posixpath.abspath(path)}")
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    info = store.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    shown = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    return sorted((f"{scheme}{f.path}" if scheme else f.path, f.size) for f in shown)


def _open(uri: str):
    store, at = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return store.open_input_file(at)


# --- mailboxes


@dataclass
class ByteRange(InputPartition):
    uri: str
    first: int
    last: int


class MailboxReader(DataSourceReader):
    """Mails whose 'From ' line (or the start of the file) lies in a range belong to it; the last one is read to its end."""

    def __init__(self, path: str, split_bytes: int) -> None:
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(uri, a, min(a + self.split_bytes, size)) for uri, size in _files(self.path) for a in range(0, size, self.split_bytes)]

    def read(self, partition: ByteRange) -> Iterator[tuple[str, int, bytes]]:
        with _open(partition.uri) as file:
            # a start is found by the line end before it; the file's own start has none
            at = max(0, partition.first - 1)
            held = (b"" if partition.first else b"\n") + file.read_at(min(CHUNK, file.size()), at)
            base = at if partition.first else -1  # offset of held[0]
            end = at + len(held) - (0 if partition.first else 1)
            start = 0 if not partition.first else None  # of the mail that is being read, within held
            seek = 0 if start is None else 1
            while True:
                hit = held.find(START, seek)
                if hit < 0:
                    more = file.read_at(CHUNK, end) if end < file.size() else b""
                    if not more:
                        if start is not None and base + 1 + start < partition.last:
                            yield partition.uri, base + 1 + start, held[start + 1 :]
                        return
                    seek = max(len(held) - len(START) + 1, seek)
                    if start is None:  # nothing before this point is wanted
                        drop = max(0, len(held) - len(START) + 1)
                        held, base, seek = held[drop:], base + drop, 0
                    held, end = held + more, end + len(more)
                    if start is None and base + 1 >= partition.last:
                        return
                    continue
                if start is not None:
                    yield partition.uri, base + 1 + start, held[start + 1 : hit + 1]
                if base + 1 + hit >= partition.last:
                    return
                held, base = held[hit:], base + hit
                start, seek = 0, 1


class Mailbox(DataSource):
    """format "mailbox": file, position, raw (from the 'From ' line on). Options: path, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return "file string, position long, raw binary"

    def reader(self, schema) -> MailboxReader:
        return MailboxReader(self.options["path"], int(self.options.get("split_bytes", 32 << 20)))


# --- dated logs


@dataclass
class LogFiles(InputPartition):
    uris: list[tuple[str, str]]  # file, its date
    limit: int | None = None


_DATE = re.compile(r"(?:^|/)date=(\d{4}-\d{2}-\d{2})(?:/|$)")


class _Newest(str):
    """Text that sorts from the largest down."""

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)


class DatedLogReader(DataSourceReader):
    """JSON lines in folders date=YYYY-MM-DD; folders outside from_date to to_date are not opened. Without a limit each
    file is a partition. With one, a single task goes from the newest folder back and stops after the folder that fills
    it, holding no more than `limit` lines; the other conditions are applied before."""

    def __init__(self, path: str, limit: int | None = None, from_date: str = "", to_date: str = "9999", since: str | None = None, least: int = 0, trace_id: str | None = None, pattern: str | None = None) -> None:
        self.path, self.limit, self.from_date, self.to_date = path, limit, from_date, to_date
        self.since, self.least, self.trace_id, self.pattern = since, least, trace_id, re.compile(pattern or "")
        self.opened: list[str] = []

    def partitions(self) -> list[LogFiles]:
        dated = [(m[1], uri) for uri, _ in _files(self.path) if (m := _DATE.search(posixpath.dirname(uri)))]
        chosen = [(uri, day) for day, uri in sorted(dated, key=lambda x: (-int(x[0].replace("-", "")), x[1])) if self.from_date <= day <= self.to_date]
        return [LogFiles([c]) for c in chosen] if self.limit is None else [LogFiles(chosen, self.limit)]

    def _lines(self, uri: str, day: str) -> Iterator[tuple]:
        from faultlens.functions.text import LEVELS

        self.opened.append(uri)
        with _open(uri) as file:
            rest = b""
            while block := file.read(CHUNK):
                *whole, rest = (rest + block).split(b"\n")
                yield from self._rows(whole, day, LEVELS)
            yield from self._rows([rest], day, LEVELS)

    def _rows(self, lines: list[bytes], day: str, levels: dict) -> Iterator[tuple]:
        for line in lines:
            try:
                said = json.loads(line)
            except ValueError:
                continue
            if not isinstance(said, dict):
                continue
            ts, level, module, trace, message = (None if said.get(c) is None else str(said[c]) for c in ("ts", "level", "module", "trace_id", "message"))
            if self.since and (ts is None or ts < self.since) or levels.get((level or "").upper(), 1) < self.least:
                continue
            if self.trace_id and trace != self.trace_id or self.pattern.pattern and (message is None or not self.pattern.search(message)):
                continue
            yield ts, level, module, trace, message, datetime.date.fromisoformat(day)

    def read(self, partition: LogFiles) -> Iterator[tuple]:
        if partition.limit is None:
            for uri, day in partition.uris:
                yield from self._lines(uri, day)
            return
        left, days = partition.limit, {}
        for uri, day in partition.uris:
            days.setdefault(day, []).append(uri)
        for day, uris in days.items():  # from the newest on
            if left <= 0:
                return
            own = heapq.nsmallest(left, (row for uri in uris for row in self._lines(uri, day)), key=lambda r: (_Newest(r[0] or ""), r[2] or "", r[4] or ""))
            yield from own
            left -= len(own)


class DatedLogs(DataSource):
    """format "dated_logs": ts, level, module, trace_id, message, date. Options: path, limit, from_date, to_date, since,
    least_level (its rank), trace_id, pattern (of Python). Conditions are options and not pushed filters: Spark 4.1 keeps
    what a filter has chosen for every later use of the same DataFrame. With a limit, lines of an older folder never come
    before newer ones."""

    @classmethod
    def name(cls) -> str:
        return "dated_logs"

    def schema(self) -> str:
        return "ts string, level string, module string, trace_id string, message string, date date"

    def reader(self, schema) -> DatedLogReader:
        o = self.options
        return DatedLogReader(o["path"], int(o["limit"]) if "limit" in o else None, o.get("from_date", ""), o.get("to_date", "9999"), o.get("since"), int(o.get("least_level", 0)), o.get("trace_id"), o.get("pattern"))


def register(spark: SparkSession) -> None:
    """Makes the formats known."""
    for source in (Mailbox, DatedLogs):
        spark.dataSource.register(source)
