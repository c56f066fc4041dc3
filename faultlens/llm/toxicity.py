"""A convolutional text classifier for toxicity, trained in numpy.

A text is a sequence of words (runs of ASCII letters and bytes above 127, A-Z lower-cased). A word's vector is the
sum of the hashed embeddings of the word and of its first 4 and 5 bytes. Filters of widths 1, 2 and 3 run over the
sequence, each filter's maximum over the text is kept, and a logistic layer makes the score, so whole texts of any
length count. Of the labelled rows a quarter, by a hash of doc_id, calibrates and is never trained on. All of it is
scored and counted by language, label and score: scores are shifted so that 0.5 separates its labels best, and each
language gets the threshold that does so for it (the language is no input of the score). The counts of all languages
together, scaled down to PRIOR rows, are added to a language's own, so the fewer rows it has the nearer its threshold
is to 0.5; a language without labelled rows has 0.5.

The model is fitted on the driver from a bounded sample of the other labelled rows: at most max_rows, equally many of
both labels where there are enough, of at most max_chars code points each (TrainingBounds). Rows with
crc32(doc_id as text) % 5 = 0 are never used. It has a fixed size (about 3 MB) and is sent to the executors. Of the
calibration one row for each language, label and one of 3001 scores reaches the driver.

Results: a null or empty text has no words and gets the score of an empty sequence; repeated rows are scored each; a
label or doc_id that is null is not learnt from; without labelled rows of both kinds every score is the share of
toxic ones (0 without any); an empty table gives an empty result; columns besides doc_id, text and, for thresholds,
lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.shared import by_bytes, trimmed
from faultlens.llm.wordhash import flatten, spans

STEP = 2 << 20
PRIOR = 40
BINS = 50  # scores counted for each unit of the logit, from -30 to 30
BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (None, 4, 5)

_BREAKS = np.ones(256, dtype=bool)
_BREAKS[ord("a") : ord("z") + 1] = False
_BREAKS[128:] = False


@dataclass(frozen=True)
class TrainingBounds:
    max_rows: int = 6000
    max_chars: int = 20_000


def _chunks(texts: list[bytes], most: int) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, len(PREFIXES)) buckets, and where each text's words begin (one more entry at the end)."""
    buffer, starts = flatten(texts)
    hashes, _, _, first = spans(buffer, starts, _BREAKS, PREFIXES)
    return np.stack([(h & np.uint64(BUCKETS - 1)).astype(np.int32) for h in hashes], axis=1), first


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # (width * DIM, FILTERS) each
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    shift: float = 0.0
    constant: float | None = None
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def pooled(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, filters) maxima (0 where a text has no word) and the words at which they stand (-1: none).
        A window may reach over the text's end, where it sees zero vectors."""
        n_texts, n = len(first) - 1, len(buckets)
        best = np.zeros((n_texts, len(WIDTHS) * FILTERS), dtype=np.float32)
        where = np.full(best.shape, -1, dtype=np.int64)
        some = np.flatnonzero(np.diff(first) > 0)
        if not len(some):
            return best, where
        x = self.embedding[buckets].sum(axis=1)
        last = np.zeros(n, dtype=bool)
        last[first[1:][some] - 1] = True
        for k, width in enumerate(WIDTHS):
            w = self.filters[k].reshape(width, DIM, FILTERS)
            out = x @ w[0]
            inside = np.ones(n, dtype=bool)
            for j in range(1, width):
                inside[: n - j + 1] &= ~last[j - 1 : n] if j > 1 else ~last  # the text goes on for j words more
                part = x[j:] @ w[j]
                out[: n - j] += part * inside[: n - j, None]
            out = np.maximum(out + self.offsets[k], 0)
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            best[some, cols] = np.maximum.reduceat(out, first[:-1][some], axis=0)
            where[some, cols] = self._argmax(out, first, some, best[some, cols])
        return best, where

    @staticmethod
    def _argmax(out, first, some, top):
        return np.zeros(top.shape, dtype=np.int64)

    def logits(self, texts: list[bytes], most: int = 1 << 19) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.float64)
        for at, own in _chunks(texts, most):
            best, _ = self.pooled(*features(own))
            out[at : at + len(own)] = best @ self.weights + self.bias - self.shift
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))


class _Trained(Model):
    """Also finds where the maxima stand."""

    @staticmethod
    def _argmax(out, first, some, top):
        n = np.diff(first)[some]
        hit = out == np.repeat(top, n, axis=0)
        place = np.where(hit, np.arange(len(out))[:, None], len(out))
        return np.minimum.reduceat(place, first[:-1][some], axis=0)


def _warm(buckets: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Small random embeddings; the first coordinate says how much more often a bucket is in toxic texts (z score)."""
    seen = np.zeros((2, BUCKETS))
    for b, y in zip(buckets, labels, strict=True):
        seen[int(y), np.unique(b)] += 1
    total = np.array([max(1, int((labels == 0).sum())), max(1, int(labels.sum()))])
    rate = (seen.sum(axis=0) + 1) / (total.sum() + 2)
    z = (seen[1] / total[1] - seen[0] / total[0]) / np.sqrt(rate * (1 - rate) * (1 / total).sum())
    out = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    out[:, 0] = np.clip(z, -12, 12) / 6
    return out


def fit(texts: list[str], labels: list[int], seed: int = 11, epochs: int = 6, rate: float = 0.02) -> Model:
    """Train on the rows. Deterministic for the same rows in the same order."""
    y = np.array(labels, dtype=np.int64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros((1, DIM), np.float32), [], [], np.zeros(0), 0.0, constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    train = np.arange(len(y))
    buckets = [features([t.encode()])[0] for t in texts]
    model = _Trained(
        _warm([buckets[i] for i in train], y[train], rng),
        [rng.normal(0, 0.1, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.full(FILTERS, -0.5, dtype=np.float32) for _ in WIDTHS],
        rng.uniform(0.1, 0.3, len(WIDTHS) * FILTERS),
        -1.0,
    )
    for k in range(len(WIDTHS)):
        model.filters[k].reshape(WIDTHS[k], DIM, FILTERS)[0, 0] += 0.5
    dense = [*model.filters, *model.offsets, model.weights]
    m1, m2 = [np.zeros_like(p, dtype=np.float64) for p in dense], [np.zeros_like(p, dtype=np.float64) for p in dense]
    squares, b1, b2, step = np.zeros(BUCKETS), 0.0, 0.0, 0
    balance = np.where(y == 1, 0.5 / max(1e-9, y[train].mean()), 0.5 / max(1e-9, 1 - y[train].mean()))
    for _ in range(epochs):
        order = rng.permutation(train)
        for a in range(0, len(order), 64):
            some = order[a : a + 64]
            first = np.cumsum([0, *(len(buckets[i]) for i in some)])
            flat = np.concatenate([buckets[i] for i in some])
            best, where = model.pooled(flat, first)
            p = 1 / (1 + np.exp(-np.clip(best @ model.weights + model.bias, -30, 30)))
            error = (p - y[some]) * balance[some] / len(some)
            gradients = [np.zeros_like(f, dtype=np.float64) for f in model.filters] + [np.zeros_like(o, dtype=np.float64) for o in model.offsets]
            back = error[:, None] * model.weights[None, :] * (best > 0)
            rows, values = [], []
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                doc, f = np.nonzero(back[:, cols])
                g, at = back[:, cols][doc, f], where[:, cols][doc, f]
                np.add.at(gradients[len(WIDTHS) + k], f, g)
                w = model.filters[k].reshape(width, DIM, FILTERS)
                shape = gradients[k].reshape(width, DIM, FILTERS)
                for j in range(width):
                    own = at + j < first[doc + 1]
                    x = model.embedding[flat[at[own] + j]].sum(axis=1)
                    np.add.at(shape[j].T, f[own], g[own][:, None] * x)
                    rows.append(flat[at[own] + j].ravel())
                    values.append(np.repeat(g[own][:, None] * w[j][:, f[own]].T, len(PREFIXES), axis=0))
            gradients.append(best.T @ error)
            step += 1
            for i, (value, g) in enumerate(zip(dense, gradients, strict=True)):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                value -= (rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)).astype(value.dtype)
            b1, b2 = 0.9 * b1 + 0.1 * error.sum(), 0.999 * b2 + 0.001 * error.sum() ** 2
            model.bias -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.999**step)) + 1e-8)
            if rows:
                row, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                g = np.zeros((len(row), DIM))
                np.add.at(g, inverse, np.concatenate(values))
                squares[row] += (g * g).mean(axis=1)
                model.embedding[row] -= (rate * g / (np.sqrt(squares[row]) + 1e-8)[:, None]).astype(np.float32)
    return Model(model.embedding, model.filters, model.offsets, model.weights, float(model.bias))


def calibrate(model: Model, counts: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Set shift and thresholds from each language's counts: ascending logits, rows with label 1 and label 0 there."""
    values, inverse = np.unique(np.concatenate([c[0] for c in counts.values()]) if counts else np.zeros(0), return_inverse=True)
    pos, neg = (np.bincount(inverse, weights=np.concatenate([c[k] for c in counts.values()]) if counts else None, minlength=len(values)) for k in (1, 2))
    if not pos.sum() or not neg.sum():
        return
    model.shift = best_cut(values, pos, neg)
    scale = PRIOR / (pos.sum() + neg.sum())
    for name, (own, own_pos, own_neg) in sorted(counts.items()):
        at = np.searchsorted(values, own)
        cut = best_cut(values, pos * scale + np.bincount(at, own_pos, len(values)), neg * scale + np.bincount(at, own_neg, len(values)), model.shift)
        model.thresholds[name] = float(1 / (1 + np.exp(-(cut - model.shift))))


def best_cut(values: np.ndarray, pos: np.ndarray, neg: np.ndarray, near: float | None = None) -> float:
    """The cut of ascending values with the fewest errors, weighing both labels alike. Among equals: `near` where it is
    one of them, or else the middle of the gap nearest to it; the middle of the widest gap where no `near` is given."""
    missed = np.concatenate(([0], np.cumsum(pos))) / pos.sum()
    false = 1 - np.concatenate(([0], np.cumsum(neg))) / neg.sum()
    loss = missed + false
    edge = np.concatenate(([values[0] - 2], values, [values[-1] + 2]))
    low, high = edge[:-1], edge[1:]
    ties = np.flatnonzero(loss <= loss.min() + 1e-12)
    if near is None:
        i = ties[np.argmax((high - low)[ties])]
        return float((low[i] + high[i]) / 2)
    if any(low[i] < near <= high[i] for i in ties):
        return near
    i = ties[np.argmin(np.abs((low + high)[ties] / 2 - near))]
    return float((low[i] + high[i]) / 2)


# --- over tables


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def _calibrates(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(23)), F.lit(4)) == 0


def train(docs: DataFrame, labels: DataFrame, bounds: TrainingBounds = TrainingBounds()) -> Model:
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select("doc_id", "text", F.coalesce(lang, F.lit("")).alias("lang"))
    # the sample is picked by doc_id before texts are joined to it; twice the rows, as some are too long or absent
    order = F.xxhash64("doc_id", F.lit(5))
    some = [known.where((F.col("toxic") == y) & ~_calibrates(F.col("doc_id"))).orderBy(order, "doc_id").limit(bounds.max_rows) for y in (0, 1)]
    picked = some[0].unionByName(some[1])  # 2 * max_rows small rows
    found = texts.where(F.length("text") <= bounds.max_chars).join(F.broadcast(picked), "doc_id").withColumn("order", order)
    half = bounds.max_rows // 2
    rows = []
    for y in (0, 1):
        rows += found.where(F.col("toxic") == y).orderBy("order", "doc_id", "text").limit(half).collect()
    rows.sort(key=lambda r: (r["order"], r["doc_id"], r["text"]))
    model = fit([r["text"] for r in rows], [r["toxic"] for r in rows])
    if model.constant is None:
        calibrate(model, _counts(texts, known.where(_calibrates(F.col("doc_id"))), model))
    return model


def _counts(texts: DataFrame, known: DataFrame, model: Model) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What `calibrate` takes, over all labelled rows kept for it. Texts are scored before labels are joined to them,
    so none of them is moved."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", STEP):
            made = shared.value.logits([(t or "").encode() for t in batch.column("text").to_pylist()])
            at = np.rint(np.clip(made, -30, 30) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(at)], ["doc_id", "lang", "at"])

    kept = texts.where((remainder(F.col("doc_id")) != 0) & _calibrates(F.col("doc_id")))
    scored = kept.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, lang string, at int")
    one = F.count(F.when(F.col("toxic") == 1, 1))
    rows = scored.join(known, "doc_id").groupBy("lang", "at").agg(one.alias("pos"), (F.count(F.lit(1)) - one).alias("neg")).collect()
    by: dict[str, list] = {}
    for r in sorted(rows):
        by.setdefault(r["lang"], []).append((r["at"] / BINS, r["pos"], r["neg"]))
    return {name: tuple(np.array(c, dtype=np.float64) for c in zip(*own, strict=True)) for name, own in by.items()}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold (of the row's language), rejected (score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", STEP):
            made = shared.value.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            cuts = [shared.value.thresholds.get(x or "", 0.5) for x in batch.column("lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64()), pa.array(cuts, pa.float64())], ["doc_id", "score", "threshold"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    base = docs.select("doc_id", lang.alias("lang"), "text")
    return (
        base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, score double, threshold double")
        .select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs below their language's threshold, with their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    has_lang = "lang" in docs.columns

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value.thresholds
        for batch in by_bytes(batches, "text", STEP):
            made = shared.value.scores([(t or "").encode() for t in batch.column("text").to_pylist()])
            langs = batch.column("lang").to_pylist() if has_lang else [None] * len(made)
            yield batch.filter(pa.array([s < cuts.get(l if l is not None else "", 0.5) for s, l in zip(made, langs, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, schema)
