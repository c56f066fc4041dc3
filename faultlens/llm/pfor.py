"""Token files with patched frame-of-reference blocks.

ids are cut into blocks of BLOCK. A block stores its minimum, and for every id the difference packed at the width
that holds the `percentile` of the block's differences; ids that need more bits are exceptions, listed with their
positions. A file ends with an index of block starts and a table of the documents (doc_id, number of ids), so any
document can be read by itself.

file: blocks, index (u64 byte offset of each block), doc_ids (i64), null flags (u8), counts (u64),
      trailer (u64 blocks, u64 documents, u64 ids, u64 offset of the index, 8 bytes magic)
block: u32 minimum, u8 width, u16 exceptions, packed differences, u16 positions, u32 differences of the exceptions
64 differences of w bits fill w little-endian u64 words, low bits first; the last block is filled up with its minimum.

Results: a null text counts as empty, and a document without ids has just the end id; documents are in ascending
(doc_id, text) order, a null doc_id first; repeated rows are written each; an empty table writes no file. Files hold
doc_ids as 64-bit numbers, so doc_id has to be of an integer type (TypeError otherwise). Columns besides doc_id and
text are not read, whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from faultlens.llm.files import Input, Output, listing
from faultlens.llm.shared import by_bytes, new_folder, partitions, split_points, trimmed, with_part

BLOCK = 1024
SEGMENT = 256 * BLOCK
STEP = 2 << 20
HEAD = struct.Struct("<IBH")
TRAILER = struct.Struct("<QQQQ8s")
MAGIC = b"PFORIDS1"
CACHED = 800_000


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) numbers below 2**width -> (blocks, BLOCK / 64 * width) u64 words."""
    v = values.reshape(len(values), BLOCK // 64, 64).astype(np.uint64)
    out = np.zeros((len(values), BLOCK // 64, width + 1), dtype=np.uint64)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        out[:, :, word] |= v[:, :, j] << np.uint64(bit)
        if bit + width > 64:
            out[:, :, word + 1] |= v[:, :, j] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out[:, :, :width]).reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack."""
    w = words.reshape(len(words), BLOCK // 64, width)
    out = np.zeros((len(words), BLOCK // 64, 64), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        if width == 0:
            break
        x = w[:, :, word] >> np.uint64(bit)
        if bit + width > 64:
            x = x | (w[:, :, word + 1] << np.uint64(64 - bit))
        out[:, :, j] = x & mask
    return out.reshape(len(words), BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray, percentile: float = 90.0) -> list[bytes]:
    """Blocks of ids (uint32); the last may be short."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    v = np.empty(n * BLOCK, dtype=np.uint32)
    v[: len(ids)] = ids
    v[len(ids) :] = ids[(n - 1) * BLOCK :].min() if len(ids) > (n - 1) * BLOCK else 0
    v = v.reshape(n, BLOCK)
    low = v.min(axis=1)
    v = v - low[:, None]
    nth = min(BLOCK - 1, int(BLOCK * percentile / 100))
    at = np.partition(v, nth, axis=1)[:, nth]
    width = np.ceil(np.log2(at.astype(np.float64) + 1)).astype(np.int64)
    over = v.astype(np.uint64) >> width.astype(np.uint64)[:, None] != 0
    body: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        packed = pack(np.where(over[own], 0, v[own]), w)
        for i, b in zip(own.tolist(), packed, strict=True):
            body[i] = b.tobytes()
    out = []
    for i in range(n):
        where = np.flatnonzero(over[i])
        out.append(HEAD.pack(int(low[i]), int(width[i]), len(where)) + body[i] + where.astype("<u2").tobytes() + v[i, where].astype("<u4").tobytes())
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that start at these offsets of data, filling included."""
    buffer = np.frombuffer(data, dtype=np.uint8)
    heads = np.ascontiguousarray(buffer[starts[:, None] + np.arange(HEAD.size)])
    low = np.ascontiguousarray(heads[:, :4]).view("<u4")[:, 0]
    width, n_over = heads[:, 4].astype(np.int64), np.ascontiguousarray(heads[:, 5:7]).view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), dtype=np.uint32)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            packed = np.ascontiguousarray(buffer[starts[own][:, None] + HEAD.size + np.arange(BLOCK // 8 * w)]).view("<u8")
            out[own] = unpack(packed, w)
    for i in np.flatnonzero(n_over).tolist():
        at = int(starts[i]) + HEAD.size + BLOCK // 8 * int(width[i])
        k = int(n_over[i])
        out[i, np.frombuffer(data, "<u2", k, at)] = np.frombuffer(data, "<u4", k, at + 2 * k)
    return (out + low[:, None]).reshape(-1)


class Writer:
    """Streams documents to one file; holds one segment of ids and the tables."""

    def __init__(self, uri: str, percentile: float = 90.0) -> None:
        self.out, self.percentile = Output(uri), percentile
        self.waiting: list[bytes] = []
        self.n_waiting = self.n_ids = 0
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= SEGMENT:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, n, SEGMENT):
            for block in encode_blocks(ids[at : min(n, at + SEGMENT)], self.percentile):
                self.starts.append(self.out.size)
                self.out.write(block)
        self.n_ids += n
        self.waiting, self.n_waiting = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> None:
        self._flush(True)
        index = self.out.size
        self.out.write(np.array(self.starts, dtype="<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], dtype=np.uint8).tobytes())
        self.out.write(np.array(self.counts, dtype="<u8").tobytes())
        self.out.write(TRAILER.pack(len(self.starts), len(self.docs), self.n_ids, index, MAGIC))
        self.out.close()


class Reader:
    def __init__(self, uri: str) -> None:
        self.file = Input(uri)
        self.n_blocks, self.n_docs, self.n_ids, self.index, magic = TRAILER.unpack(self.file.read(self.file.size - TRAILER.size, TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def tables(self) -> tuple[np.ndarray, list[int | None], np.ndarray]:
        """(block starts with the end, doc_ids, counts)."""
        data = self.file.read(self.index, self.file.size - TRAILER.size - self.index)
        starts = np.append(np.frombuffer(data, "<u8", self.n_blocks), self.index).astype(np.int64)
        at = 8 * self.n_blocks
        ids, none = np.frombuffer(data, "<i8", self.n_docs, at).tolist(), np.frombuffer(data, np.uint8, self.n_docs, at + 8 * self.n_docs).tolist()
        counts = np.frombuffer(data, "<u8", self.n_docs, at + 9 * self.n_docs).astype(np.int64)
        return starts, [None if x else d for d, x in zip(ids, none, strict=True)], counts

    def ids(self, first: int, last: int, starts: np.ndarray) -> np.ndarray:
        """ids of blocks first to last - 1."""
        data = self.file.read(int(starts[first]), int(starts[last] - starts[first]))
        return decode_blocks(data, starts[first:last] - starts[first])[: self.n_ids - first * BLOCK]

    def documents(self, blocks: int = 256) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) one by one, reading `blocks` blocks at a time."""
        starts, docs, counts = self.tables()
        have, at = np.zeros(0, dtype=np.uint32), 0
        for doc, n in zip(docs, counts.tolist(), strict=True):
            parts, got = [have[:n]], min(n, len(have))
            have = have[n:]
            while got < n:
                more = self.ids(at, min(self.n_blocks, at + blocks), starts)
                at = min(self.n_blocks, at + blocks)
                parts.append(more[: n - got])
                have = more[n - got :]
                got += len(parts[-1])
            yield doc, parts[0] if len(parts) == 1 else np.concatenate(parts)


# --- encoding with a word-level BPE of the tokenizers library

# pre-tokens over lower-cased ASCII and Latin-1 letters, as the pattern in the vocabulary's file splits them
_UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_SPACES = re.compile("[ \t-\r]+")
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """key -> make(key), bounded: when full it takes no more for as many misses as it has entries, then starts anew, so
    that frequent keys stay most of the time and rare ones do not push them out."""

    def __init__(self, make, most: int = CACHED) -> None:
        super().__init__()
        self.make, self.most, self.missed = make, most, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most:
            if len(key) < 64:
                self[key] = value
        else:
            self.missed += 1
            if self.missed >= self.most:
                self.missed = 0
                self.clear()
        return value


class WordEncoder:
    """Encodes with the tokenizers library. This kind of vocabulary drops white space and never merges across it, so
    what stands between two white-space characters is encoded once and kept (bounded). Plain pieces (ASCII, Latin-1
    letters) go to the library's merge model directly, all others through its whole pipeline. A text in which the
    string of an added token stands goes to the library as a whole, which gives such strings ids of their own."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = self.tokenizer.get_added_tokens_decoder().values()
        case = re.IGNORECASE if any(t.normalized for t in added) else 0
        self.added = re.compile("|".join(re.escape(t.content) for t in added) if added else "(?!)", case)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces = _Kept(self._piece)

    def _unit(self, unit: str) -> bytes:
        tokens = self.model.tokenize(unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters))
        return b"".join([self.raw[t.id] for t in tokens])

    def _piece(self, piece: str) -> bytes:
        """Units are pieces too: one cache holds both, and a word's forms share what its small letters give."""
        if not _PLAIN.fullmatch(piece):
            return self._library(piece)
        low = piece.lower()
        if low.isalpha():  # of plain characters, letters only: one unit
            return self._unit(low) if low == piece else self.pieces[low]
        units = _UNITS.findall(low)
        return self._unit(low) if units == [piece] else b"".join(map(self.pieces.__getitem__, units))

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.added.search(text):
            return self._library(text)
        words = [w for w in _SPACES.split(text) if w] if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, words))


_encoders: dict[int, WordEncoder] = {}


def write(docs: DataFrame, vocabulary: str, end_id: int = 2, folder: str | None = None, n_files: int | None = None, percentile: float = 90.0) -> str:
    """Encode docs and write their ids, each document with end_id appended, to part-NNNNNN.pfor files of the folder
    in ascending doc_id order over all files; returns the folder."""
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id has to be of an integer type")
    folder = folder or new_folder(spark, "token-files")
    n = n_files or partitions(spark)
    with open(vocabulary, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    key = hash(source.value)
    end = np.array([end_id], dtype="<u4").tobytes()
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    points = split_points(base, "doc_id", n)
    parted = with_part(base, "doc_id", points, "part").repartitionById(len(points) + 1, "part").sortWithinPartitions("part", "doc_id", "text")

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = WordEncoder(source.value)
        encode, out, at = _encoders[key].encode, None, None
        for batch in by_bytes(batches, "text", STEP):
            for doc, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                if part != at:
                    if out is not None:
                        out.close()
                    out, at = Writer(f"{folder}/part-{part:06d}.pfor", percentile), part
                out.add(doc, encode(text) + end)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"n": pa.array([out.n_ids], pa.int64())})

    parted.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian u32)."""
    return _read(spark, folder, lambda ids: ids.astype("<u4").tobytes(), pa.binary(), "ids binary")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned crc32 of the ids as little-endian u32)."""
    return _read(spark, folder, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32 long")


def _read(spark: SparkSession, folder: str, make, kind: pa.DataType, field: str) -> DataFrame:
    files = [uri for uri, _ in listing(folder, ".pfor")]
    schema = f"doc_id long, start long, n_tokens long, {field}"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "nth int, uri string")

    def totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for uri in batch.column("uri").to_pylist():
                with Reader(uri) as file:
                    n.append(file.n_ids)
            yield pa.RecordBatch.from_arrays([batch.column("nth"), pa.array(n, pa.int64())], ["nth", "n"])

    # one number a file reaches the driver; the number of files is a parameter of the writer
    n_ids = [r["n"] for r in sorted(listed.mapInArrow(totals, "nth int, n long").collect())]
    first = np.cumsum([0, *n_ids])
    starts = spark.createDataFrame([(i, f, int(first[i])) for i, f in enumerate(files)], "nth int, uri string, first long")

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, at in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist(), strict=True):
                rows: tuple[list, list, list, list] = ([], [], [], [])
                with Reader(uri) as file:
                    held = 0
                    for doc, ids in file.documents():
                        for to, value in zip(rows, (doc, at, len(ids), make(ids)), strict=True):
                            to.append(value)
                        at += len(ids)
                        held += len(ids)
                        if len(rows[0]) >= 2000 or held >= SEGMENT:
                            yield _rows(rows, kind, field)
                            rows, held = ([], [], [], []), 0
                yield _rows(rows, kind, field)

    return starts.repartitionById(len(files), "nth").mapInArrow(run, schema)


def _rows(rows: tuple[list, ...], kind: pa.DataType, field: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), kind)
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["doc_id", "start", "n_tokens", field.split()[0]])
