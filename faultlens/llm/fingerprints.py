"""Improbable-feature digests of documents.

Each window of WIDTH bytes of a text has an entropy (0..SCALE). How rare an entropy is among the windows of all
documents gives a window its rank; in every run of RUN neighbouring windows the rarest one scores, and windows that
score at least `popular` times are the text's features. Features are put, in order, into a chain of Bloom filters of
BITS bits, PER features each. Two digests are compared filter by filter: the bits in common, less what unrelated
filters of the same fullness share by chance, over what the emptier one could share; each filter of the shorter chain
counts with its best partner, weighted by its features.

The arithmetic runs on one flat buffer of many texts with gaps between them, so no window spans two texts and the
digest of a text depends on nothing but the text (and the ranks). A text shorter than a window has one window,
filled with zero bytes; an empty or null text has no filter. Two digests without filters have likeness 1, one with
and one without 0. Repeated rows are treated alike; an empty table gives an empty result. Rows stand in order of
(doc_id, text), a null doc_id first; doc_id has to be numeric for comparing with the next document (TypeError
otherwise). Columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm.shared import by_bytes, partitions, split_points, trimmed, with_part
from faultlens.llm.wordhash import mix64, powers

WIDTH = 16
RUN = 32
POPULAR = 8
SCALE = 1000
BITS = 2048
HASHES = 5
PER = 160
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_ONE = 1 << 24
_CHUNK = 1 << 18
STEP = 2 << 20

_c = np.arange(WIDTH + 2, dtype=np.float64)
_CLOGC = np.rint(np.where(_c > 0, _c * np.log2(np.maximum(_c, 1)), 0) * _ONE).astype(np.int64)
_STEP_UP = np.concatenate(([0], _CLOGC[1:] - _CLOGC[:-1]))  # by the count after a byte came in
_FULL = int(_CLOGC[WIDTH])
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


class Texts:
    """Texts in one buffer, with room between them; windows[k] of text k begin at starts[k]."""

    def __init__(self, texts: list[bytes]) -> None:
        gap = WIDTH + RUN
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.starts = gap + np.cumsum(lengths + gap) - lengths - gap
        self.windows = np.where(lengths > 0, np.maximum(lengths - WIDTH + 1, 1), 0)
        pad = b"\0" * gap
        self.buffer = np.frombuffer(pad + pad.join(texts) + pad, dtype=np.uint8)

    def entropies(self) -> np.ndarray:
        """The entropy of the window at each byte, 0..SCALE; exact sums of fixed-point numbers."""
        t = self.buffer
        n = len(t) - WIDTH + 1
        ahead, back = np.ones(len(t), dtype=np.uint8), np.ones(len(t), dtype=np.uint8)
        for a in range(0, len(t), _CHUNK):  # chunks that stay in the cache
            b = min(len(t), a + _CHUNK)
            for d in range(1, WIDTH):
                e = min(b, len(t) - d)
                if e > a:
                    same = (t[a:e] == t[a + d : e + d]).view(np.uint8)
                    ahead[a:e] += same
                    back[a + d : e + d] += same
        first = np.bincount(t[:WIDTH], minlength=256)
        change = _STEP_UP[back[WIDTH:]]
        # the byte that leaves was counted `ahead` times in its window; where it equals the new one, that was there too
        change -= _STEP_UP[np.minimum(ahead[: len(t) - WIDTH], WIDTH)]
        total = np.empty(n, dtype=np.int64)
        total[0] = _CLOGC[first].sum()
        total[1:] = change
        np.cumsum(total, out=total)
        return ((_FULL - total) * SCALE // _FULL).astype(np.int32)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, byte) of every window."""
        text = np.repeat(np.arange(len(self.starts)), self.windows)
        return text, np.repeat(self.starts - (np.cumsum(self.windows) - self.windows), self.windows) + np.arange(len(text))


def pieces(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `most` bytes: (index of the first, texts)."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def entropy_counts(texts: list[bytes]) -> np.ndarray:
    """How many windows have each entropy."""
    counts = np.zeros(SCALE + 1, dtype=np.int64)
    for _, some in pieces(texts):
        flat = Texts(some)
        if flat.windows.any():
            counts += np.bincount(flat.entropies()[flat.own()[1]], minlength=SCALE + 1)
    return counts


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank by entropy: 0 for the rarest, ties by entropy, higher first; entropies that never occur are the rarest."""
    order = np.lexsort((-np.arange(SCALE + 1), counts))
    ranks = np.empty(SCALE + 1, dtype=np.int32)
    ranks[order] = np.arange(SCALE + 1)
    return ranks


def _features(flat: Texts, ranks: np.ndarray, popular: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, byte) of the windows that are features, in order."""
    text, at = flat.own()
    # sort key: rank, then place; windows that belong to no text come last
    place = np.arange(len(flat.buffer) - WIDTH + 1, dtype=np.int64)
    key = place + (np.int64(SCALE + 1) << 32)
    key[at] = at + (ranks[flat.entropies()[at]].astype(np.int64) << 32)
    low, width = key, 1
    while width < RUN:  # minimum of runs of RUN windows, by doubling
        step = min(width, RUN - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    rarest = low[low < np.int64(SCALE + 1) << 32] & np.int64(0xFFFFFFFF)
    score = np.bincount(rarest, minlength=len(flat.buffer))
    chosen = score[at] >= popular
    # a text in which no window is popular enough has its best one
    some = np.flatnonzero(flat.windows)
    if len(some):
        begin = np.searchsorted(text, some)
        without = np.add.reduceat(chosen, begin) == 0
        for k, b in zip(some[without], begin[without], strict=True):
            chosen[b + int(np.argmin(key[at[b : b + flat.windows[k]]]))] = True
    return text[chosen], at[chosen]


def digest(texts: list[bytes], ranks: np.ndarray, popular: int = POPULAR) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its filters, (n, BITS / 8) uint8, and their numbers of features."""
    out = []
    for _, some in pieces(texts):
        flat = Texts(some)
        text, at = _features(flat, ranks, popular) if flat.windows.any() else (np.zeros(0, np.int64),) * 2
        sums = np.zeros(len(flat.buffer) + 1, dtype=np.uint64)
        np.cumsum((flat.buffer.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(flat.buffer)), out=sums[1:])
        value = mix64((sums[at + WIDTH] - sums[at]) * powers(_INVERSE, len(flat.buffer) + 1)[at])
        first = np.searchsorted(text, np.arange(len(some) + 1))
        nth = np.arange(len(text)) - first[text]
        n_filters = -(-np.diff(first) // PER)
        base = np.cumsum(n_filters) - n_filters
        flags = np.zeros((int(n_filters.sum()), BITS), dtype=np.uint8)
        row = base[text] + nth // PER
        for k in range(HASHES):
            flags[row, (value >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = 1
        bits = np.packbits(flags, axis=1)
        held = np.bincount(row, minlength=len(bits))
        out += [(bits[a : a + n], held[a : a + n]) for a, n in zip(base.tolist(), n_filters.tolist(), strict=True)]
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0 if len(b[0]) else 1.0
    ones_a, ones_b = (_POPCOUNT[x[0]].sum(axis=1, dtype=np.int64) for x in (a, b))
    best = np.zeros(len(a[0]))
    for i in range(len(a[0])):
        common = _POPCOUNT[a[0][i] & b[0]].sum(axis=1, dtype=np.int64)
        chance = ones_a[i] * ones_b / BITS
        spread = 3 * np.sqrt(chance * (1 - ones_a[i] / BITS))
        floor = np.minimum(chance + spread, np.minimum(ones_a[i], ones_b) - 1)
        score = (common - floor) / (np.minimum(ones_a[i], ones_b) - floor)
        best[i] = np.clip(score, 0, 1).max()
    return float((best * a[1]).sum() / a[1].sum())


def written(filters: tuple[np.ndarray, np.ndarray]) -> str:
    """chain length, features and bits as text."""
    bits, held = filters
    return f"{len(bits)}:{int(held.sum())}:{base64.b64encode(bits.tobytes()).decode()}"


def parsed(text: str) -> tuple[np.ndarray, np.ndarray]:
    n, held, bits = text.split(":")
    count = np.full(int(n), PER)
    if len(count):
        count[-1] = int(held) - PER * (int(n) - 1)
    return np.frombuffer(base64.b64decode(bits), dtype=np.uint8).reshape(int(n), BITS // 8), count


# --- over tables


def fit_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks from the windows of every text of the table: one pass, SCALE + 1 sums reach the driver."""

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SCALE + 1, dtype=np.int64)
        for batch in by_bytes(batches, "text", STEP):
            counts += entropy_counts([t.encode() for t in batch.column("text").to_pylist() if t])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], ["entropy", "n"])

    counts = np.zeros(SCALE + 1, dtype=np.int64)
    for r in docs.select("text").mapInArrow(run, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect():
        counts[r["entropy"]] = r["n"]
    return ranks_of(counts)


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """doc_id, fingerprint."""
    ranks = fit_ranks(docs) if ranks is None else ranks

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", STEP):
            made = [written(d) for d in digest([(t or "").encode() for t in batch.column("text").to_pylist()], ranks)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    base = docs.select("doc_id", "text")
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, n_parts: int | None = None) -> DataFrame:
    """part, doc_id, text, guest: docs dealt into parts by ranges of doc_id (null first), one part a partition, sorted
    by (doc_id, text). After its own rows each part has one guest, the first row of the next part that has rows (for the
    last part, of the first), so every row's successor stands right behind it."""
    spark: SparkSession = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    points = split_points(base, "doc_id", n_parts or partitions(spark))
    parted = with_part(base, "doc_id", points, "part")
    # the first row of each part: as many rows as parts; only they are aggregated
    lowest = parted.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("low"))
    firsts = parted.join(F.broadcast(lowest), "part").where(F.col("doc_id").eqNullSafe(F.col("low.doc_id"))).groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("row"))
    order = [r["part"] for r in lowest.select("part").orderBy("part").collect()]
    to = dict(zip(order[1:] + order[:1], order, strict=True))
    pairs = spark.createDataFrame(list(to.items()) or [(0, 0)], "part int, host int").coalesce(1)
    guests = firsts.join(F.broadcast(pairs), "part").select(F.col("host").alias("part"), "row.doc_id", "row.text", F.lit(True).alias("guest"))
    every = parted.select("part", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests)
    return every.repartitionById(len(points) + 1, "part").sortWithinPartitions("part", "guest", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """text with its last half (floor) replaced by the first as many code points of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edited(docs: DataFrame, ranks: np.ndarray | None = None, n_parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ranks = fit_ranks(docs) if ranks is None else ranks
    parted = with_next(docs, n_parts)
    kind = parted.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def made(ids: list, texts: list[str], id_type: pa.DataType) -> pa.RecordBatch:
        """Rows of all but the last text, which is there as a successor."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        raw = [t.encode() for t in texts]
        raw_changed = [t.encode() for t in changed]
        own, other = digest(raw, ranks), digest(raw_changed, ranks)
        columns = [
            pa.array(ids[:-1], id_type),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in raw_changed]),
            pa.array([written(d) for d in own[:-1]]),
            pa.array([written(d) for d in other]),
            pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in by_bytes(batches, "text", STEP):
            id_type = batch.schema.field("doc_id").type
            for doc, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "guest")), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text)
                if len(texts) > 1 and (guest or size >= STEP):
                    yield made(ids, texts, id_type)
                    ids, texts, size = ([], [], 0) if guest else (ids[-1:], texts[-1:], len(text))

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return parted.mapInArrow(run, schema)
