"""Nearest vectors by dot product: blocks of vectors meet blocks of queries, each pair of blocks is one matrix product."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.operators.ranking import top_n

BLOCK = 4096


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v) -> rows of up to BLOCK vectors of one length: ids, flat."""
    for batch in batches:
        size = batch.column("v").value_lengths().to_numpy()
        for n in np.unique(size).tolist():
            rows = np.flatnonzero(size == n)
            for at in range(0, len(rows), BLOCK):
                some = batch.take(pa.array(rows[at : at + BLOCK]))
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (some.column("id"), some.column("v").flatten())]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *lists], ["size", "ids", "flat"])


def _best(k: int, margin: float):
    """Pairs of blocks -> for each query the pairs that may be among its k best once scores are rounded. The product chooses
    them; their scores are then added up in the order of the dimensions, as a plain loop does."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                size = batch.column("size")[row].as_py()
                ids, q_ids = batch.column("ids")[row].values, batch.column("q_ids")[row].values
                of = lambda c: batch.column(c)[row].values.to_numpy().reshape(-1, size) if size else np.zeros((0, 0))  # noqa: E731, B023
                v, q = of("flat") if size else np.zeros((len(ids), 0)), of("q_flat") if size else np.zeros((len(q_ids), 0))
                number, q_number = ids.to_numpy(), q_ids.to_numpy()
                rough = q @ v.T
                same = q_number[:, None] == number[None, :]
                known = np.where(same | ~np.isfinite(rough), -np.inf, rough)
                least = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] > k else np.full(len(q_number), -np.inf)
                a, b = np.nonzero((((rough >= (least - margin)[:, None]) | ~np.isfinite(rough)) & ~same))
                score = np.zeros(len(a))
                for j in range(size):
                    score += q[a, j] * v[b, j]
                # of equal scores the k smallest ids are enough
                order = np.lexsort((number[b], score, a))
                a, b, score = a[order], b[order], score[order]
                new = np.concatenate(([True], (np.diff(a) != 0) | (score[1:] != score[:-1])))[: len(a)]
                first = np.flatnonzero(new)
                few = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < k
                yield pa.RecordBatch.from_arrays([pa.array(q_number[a[few]]), pa.array(number[b[few]]), pa.array(score[few])], ["query", "id", "score"])

    return run


def nearest(vectors: DataFrame, asked: Column, key: str, vector: str, k: int, digits: int) -> DataFrame:
    """query, key, score: for each row that is asked for, the k other rows with the highest dot product, rounded to so
    many digits; equal ones by key, NULL last. key: a long; vector: array<double>. A product with a vector that is NULL,
    has a NULL in it or another length is NULL."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), asked.alias("asked")).where("id is not null")
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    pack = lambda df: df.select("id", "v").mapInArrow(_packed, "size int, ids array<long>, flat array<double>")
    blocks, asked_blocks = pack(rows.where(whole)), pack(rows.where(whole).where("asked"))
    pairs = blocks.join(asked_blocks.select("size", F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat")), "size")
    scored = pairs.mapInArrow(_best(k, 1.1 * 10.0**-digits), "query long, id long, score double").withColumn("score", F.round("score", digits))
    # pairs without a score come last, so of each kind the smallest k + 1 keys are enough
    queries, kind = rows.where("asked"), F.when(whole, F.size("v")).otherwise(-1)
    few = top_n(rows.select("id", kind.alias("kind")), ["kind"], [F.col("id")], k + 1).select("id", "kind")
    rest = queries.select(F.col("id").alias("query"), kind.alias("q_kind")).join(F.broadcast(few), (F.col("kind") != F.col("q_kind")) | (F.col("kind") == -1))
    rest = rest.where("id <> query").select("query", "id", F.lit(None).cast("double").alias("score"))
    best = top_n(scored.unionByName(rest), ["query"], [F.desc_nulls_last("score"), F.col("id")], k)
    return best.select("query", F.col("id").alias(key), "score")
