"""Byte files in a shared store, written and read by Python workers through pyarrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


class Output:
    """A file that appears under its name only when complete, so a task that is lost or run twice does no harm."""

    def __init__(self, uri: str) -> None:
        self.store, self.path = fs.FileSystem.from_uri(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex[:8]}.part"
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream, self.size = self.store.open_output_stream(self.part), 0

    def write(self, data: bytes | memoryview) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.store.move(self.part, self.path)


class Input:
    def __init__(self, uri: str) -> None:
        self.store, self.path = fs.FileSystem.from_uri(uri)
        self.file = self.store.open_input_file(self.path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


def listing(folder: str, ends: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files in a folder with that ending, by name."""
    store, path = fs.FileSystem.from_uri(folder)
    base = folder[: len(folder) - len(path.rstrip("/"))] if folder.rstrip("/").endswith(path.rstrip("/")) else ""
    found: Iterable[fs.FileInfo] = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f"{folder.rstrip('/')}/{f.base_name}" if not base else f"{base}{f.path}", f.size) for f in found if f.path.endswith(ends))
