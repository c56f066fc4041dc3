"""Byte-level BPE encoding and decoding of whole texts, by overlapping chunks.

A text is a run of pre-tokens (the matches of a pattern) and each is merged by itself. Short texts are pre-tokenised
at once. A text of more than chunk_chars code points is cut into chunks that overlap by `overlap` on both sides; the
chunks are pre-tokenised in parallel, each from its own start. Where a chunk and the one before it share a boundary
in their common stretch they have resynchronised: a match depends on the text from its start on, so from a common
boundary on both see the same pre-tokens. The text is cut there, and the pieces are merged in parallel and put
together in order.

A boundary serves as a cut only where the piece before it also reads the same by itself: the pattern looks past a run
of white space (`\\s+(?!\\S)`), so the character before a cut is never white space; and it lies at least MARGIN code
points before the end of the chunk that found it, as a match that ends nearer could be longer in the whole text. A
text in which some pair of neighbours shares no such boundary (one long run) is encoded as one piece instead.
Decoding looks up every id's bytes and concatenates them.

Results: a null text counts as empty and has no ids; repeated rows give one result each, null doc_ids too; ids are
little-endian unsigned 32-bit numbers in a binary column; an empty table gives an empty result; columns besides
doc_id and text are not read, whatever their names. Bytes that decoding yields may end inside a character only where
the ids do.

The vocabulary (under 1 MB) is read by the driver and sent to executors, where each Python worker keeps a bounded
cache of merged pieces. Texts are taken from Arrow batches in steps of STEP bytes, chunks travel by themselves, and
only the row of a text's ids is as long as the text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.shared import by_bytes, trimmed

CACHED_BYTES = 16 << 20
STEP = 2 << 20
HASHED = 1 << 16  # ids a step of a digest
MARGIN = 4

# Unicode White_Space, as \s of the pattern means it (fixed values)
_WS = "\t-\r \x85\xa0  -     　"
_RUNS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_IRREGULAR = re.compile(f"[{_WS}][{_WS}]|^[{_WS}]|[{_WS}]$")
_SPACE = re.compile(f"[{_WS}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Pieces(dict):
    """piece -> ids as bytes; forgets all when its entries come to about CACHED_BYTES."""

    def __init__(self, codec: Codec, lead: str) -> None:
        super().__init__()
        self.codec, self.lead, self.held = codec, lead, 0

    def __missing__(self, piece: str) -> bytes:
        value = np.asarray(self.codec.merged(self.lead + piece), dtype="<u4").tobytes()
        if len(piece) < 64:
            self.held += 4 * len(piece) + len(value) + 200
            if self.held > CACHED_BYTES:
                self.clear()
                self.held = 0
            self[piece] = value
        return value


class Codec:
    """Encoder and decoder for one vocabulary; one for each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        self.merge = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.after_space, self.bare = _Pieces(self, " "), _Pieces(self, "")
        size = max(ranks.values(), default=-1) + 1
        words = [b""] * size
        for word, rank in ranks.items():
            words[rank] = word
        self.length = np.fromiter((len(w) for w in words), dtype=np.int64, count=size)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.decimal = [str(i) for i in range(size)]

    def merged(self, piece: str) -> list[int]:
        return [i for token in self.pattern.findall(piece) for i in self.merge(token)]

    def encode(self, text: str) -> bytes:
        """ids as bytes. Texts are taken apart at white space, where pre-tokens surely end: before every single space,
        or else at the ends of runs of white space."""
        if not text:
            return b""
        if _IRREGULAR.search(text) is None:
            first, *rest = text.split(" ")
            return self.bare[first] + b"".join(map(self.after_space.__getitem__, rest))
        return b"".join(map(self.bare.__getitem__, _RUNS.findall(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, one after the other."""
        n = self.length[ids]
        end = np.cumsum(n)
        if not len(end) or not end[-1]:
            return b""
        return self.flat[np.repeat(self.start[ids] - (end - n), n) + np.arange(end[-1])].tobytes()

    def boundaries(self, text: str, low: int, high: int) -> list[int]:
        """Pre-token ends in (low, high] that may serve as cuts, when pre-tokenising starts at the start of text."""
        at, out = 0, []
        for run in _RUNS.findall(text):
            end = at + len(run)
            if end > low:
                if at >= high:
                    break
                if _SPACE.match(run[-1]) is None:
                    out += [at + token.end() for token in self.pattern.finditer(run) if low < at + token.end() <= high]
            at = end
        return out


_codecs: dict[str, Codec] = {}


def _codec(key: str, source) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(*source.value)
    return _codecs[key]


def ids_only(ids: bytes, codec: Codec) -> dict:
    return {"ids": ids}


def digests(ids: bytes, codec: Codec) -> dict:
    """Digests of the decimal ids joined by spaces and of the bytes decoded from the ids."""
    said, decoded = hashlib.sha256(), hashlib.sha256()
    all_ = np.frombuffer(ids, dtype="<u4")
    for at in range(0, len(all_), HASHED):
        some = all_[at : at + HASHED]
        said.update(((" " if at else "") + " ".join(map(codec.decimal.__getitem__, some.tolist()))).encode())
        decoded.update(codec.decode(some))
    return {"ids_sha256": said.hexdigest(), "decoded_sha256": decoded.hexdigest()}


Finish = Callable[[bytes, Codec], dict]
_FIELDS = {ids_only: "ids binary", digests: "ids_sha256 string, decoded_sha256 string"}


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, chunk_chars: int = 16_384, overlap: int = 512, finish: Finish = ids_only
) -> DataFrame:
    """doc_id, n_tokens and what `finish` makes of a text's ids (ids_only: ids; digests: two hashes)."""
    if chunk_chars <= 2 * overlap:
        raise ValueError("chunks have to be longer than two overlaps")
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast((read_ranks(vocabulary), pattern))
    key = f"{vocabulary} {pattern}"
    fields = _FIELDS[finish]

    def finished(doc_ids: pa.Array, made: list[bytes], codec: Codec) -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pylist([{"n_tokens": len(ids) // 4} | finish(ids, codec) for ids in made])
        return pa.RecordBatch.from_arrays([doc_ids, *rows.columns], ["doc_id", *rows.schema.names])

    @trimmed
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, source)
        for some in by_bytes(batches, "text", STEP):
            yield finished(some.column("doc_id"), [codec.encode(t) for t in some.column("text").to_pylist()], codec)

    @trimmed
    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_bytes(batches, "text", STEP):
            for row, text in enumerate(some.column("text").to_pylist()):
                text_key = hashlib.sha256(text.encode()).hexdigest()
                n = -(-len(text) // chunk_chars)
                for at in range(0, n, 64):
                    own = range(at, min(n, at + 64))
                    start = [max(0, c * chunk_chars - overlap) for c in own]
                    part = [text[a : (c + 1) * chunk_chars + overlap] for a, c in zip(start, own, strict=True)]
                    columns = [some.column("doc_id").take(pa.array([row] * len(own))), pa.array([text_key] * len(own)), pa.array(own, pa.int32()), pa.array(start, pa.int64()), pa.array(part)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "chunk", "start", "text"])

    @trimmed
    def bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Boundaries near both ends of each chunk. Chunks of rows that are alike stand side by side and become one."""
        codec = _codec(key, source)
        waiting, copies, last = None, 0, None
        kind = pa.list_(pa.int64())

        def found() -> pa.RecordBatch:
            text, chunk, start = (waiting.column(c)[0].as_py() for c in ("text", "chunk", "start"))
            nominal = chunk * chunk_chars - start  # where this chunk begins without its overlap

            def near(at: int) -> list[int]:
                return [start + b for b in codec.boundaries(text, max(0, at - overlap), min(at + overlap, len(text) - MARGIN))]

            columns = [*waiting.columns, pa.array([copies], pa.int32()), pa.array([near(nominal) if chunk else []], kind), pa.array([near(nominal + chunk_chars)], kind)]
            return pa.RecordBatch.from_arrays(columns, [*waiting.schema.names, "copies", "head", "tail"])

        for some in by_bytes(batches, "text", STEP):
            for row, this in enumerate(zip(*(some.column(c).to_pylist() for c in ("doc_id", "text_key", "chunk")), strict=True)):
                if this == last:
                    copies += 1
                    continue
                if waiting is not None:
                    yield found()
                waiting, copies, last = some.slice(row, 1), 1, this
        if waiting is not None:
            yield found()

    @trimmed
    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, source)
        for some in by_bytes(batches, "text", STEP):
            ids = [codec.encode(t) for t in some.column("text").to_pylist()]
            yield some.set_column(some.schema.get_field_index("text"), "ids", pa.array(ids, pa.binary()))

    @trimmed
    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, source)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = b"".join(batch.column("parts")[row].as_py())
                yield finished(batch.column("doc_id").slice(row, 1), [ids], codec)

    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {id_type}, n_tokens long, {fields}"
    short = base.where(F.length("text") <= chunk_chars).mapInArrow(whole, result)

    name = ["doc_id", "text_key"]
    kind = f"doc_id {id_type}, text_key string, chunk int, start long, text string"
    spread = (
        base.where(F.length("text") > chunk_chars)
        .mapInArrow(chunks, kind)
        .repartition(*name, "chunk")
        .sortWithinPartitions(*name, "chunk")
    )
    order = Window.partitionBy(*name).orderBy("chunk")
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stitched = (
        spread.mapInArrow(bounds, f"{kind}, copies int, head array<long>, tail array<long>")
        .withColumn("cut", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order)))))
        .withColumn("next_cut", F.lead("cut").over(order))
        .withColumn("failed", F.max(F.col("cut").isNull()).over(all_))
    )
    own = F.substring(
        "text", (F.col("cut") - F.col("start")).cast("int") + 1, F.coalesce(F.col("next_cut") - F.col("cut"), F.lit(2**31 - 1)).cast("int")
    )
    good = stitched.where("not failed").select(*name, "copies", "chunk", own.alias("text"))
    # a text that never resynchronises somewhere: its chunks without their overlaps, put together again
    bare = F.substring("text", (F.col("chunk") * chunk_chars - F.col("start")).cast("int") + 1, F.lit(chunk_chars))
    bad = (
        stitched.where("failed")
        .groupBy(*name, "copies")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", bare.alias("t")))).alias("all"))
        .select(*name, "copies", F.lit(0).alias("chunk"), F.array_join(F.transform("all", lambda c: c["t"]), "").alias("text"))
    )
    encoded = good.unionByName(bad).mapInArrow(pieces, f"doc_id {id_type}, text_key string, copies int, chunk int, ids binary")
    together = (
        encoded.groupBy(*name, "copies")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("all"))
        .select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), F.transform("all", lambda c: c["ids"]).alias("parts"))
        .select("doc_id", "parts")
    )
    return short.unionByName(together.mapInArrow(joined, result))


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, content (binary): the bytes of each row's ids."""
    source = encoded.sparkSession.sparkContext.broadcast((read_ranks(vocabulary), pattern))
    key = f"{vocabulary} {pattern}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, source)
        for batch in batches:
            out = [codec.decode(np.frombuffer(i or b"", dtype="<u4")) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "content"])

    base = encoded.select("doc_id", "ids")
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, content binary")
