"""Reranking of hits by an injected scorer, with a gate before it and the order of retrieval behind it.

The scorer runs where the hits are, on batches of (question, text) pairs; it is made once a Python worker. Fewer
scores than pairs are filled up with 0, more are cut off. A scorer that cannot be made or fails leaves the first `keep`
hits of each question in the order they came, so that an answer is never lost to it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from faultlens.operators.ranking import top_n

Scorer = Callable[[list[tuple[str, str]]], list[float]]
KEEP, THRESHOLD, CAP, BATCH, CHARS = 10, 1, 100, 32, 1024


def reranked(hits: DataFrame, make: Callable[[], Scorer], by: list[str], question: str, text: str, place: str, keep: int = KEEP, threshold: int = THRESHOLD, cap: int = CAP, batch: int = BATCH, enabled: bool = True) -> DataFrame:
    """The `keep` best of the first `cap` hits of each question (columns `by`) with rank and rerank_score. place: the order of
    retrieval, from 1. Questions with at most `threshold` hits, and all where not enabled, keep all their hits in
    their order, without a score."""
    pairs = hits.withColumn("_n", F.count(F.lit(1)).over(_all(by)))
    many = (F.col("_n") > threshold) & F.lit(enabled)
    if not enabled:
        scored = pairs.withColumn("rerank_score", F.lit(None).cast("double"))
    else:

        def loaded():
            try:
                score = make()
            except Exception:  # no scorer: nobody gets a score
                score = None

            def run(questions: np.ndarray, texts: np.ndarray) -> np.ndarray:
                n = len(questions)
                try:
                    made = [float(x) for x in score([(str(q), str(t)) for q, t in zip(questions, texts, strict=True)])][:n]
                except Exception:
                    return np.full(n, np.nan)
                return np.array(made + [0.0] * (n - len(made)))

            return run

        model = predict_batch_udf(loaded, return_type=DoubleType(), batch_size=batch)
        score = model(F.coalesce(question, F.lit("")), F.left(F.coalesce(text, F.lit("")), F.lit(CHARS)))
        # hits of questions that need no order are not sent to the scorer
        first = top_n(pairs.where(many), by, [F.col(place)], cap).drop("rn")
        scored = first.withColumn("rerank_score", F.nanvl(score, F.lit(None).cast("double"))).unionByName(pairs.where(~many).withColumn("rerank_score", F.lit(None).cast("double")))
        failed = F.max(F.col("rerank_score").isNull()).over(_all(by))  # one batch without scores: the question keeps its order
        scored = scored.withColumn("rerank_score", F.when(~failed, F.col("rerank_score")))
    order = [F.desc_nulls_last(F.round("rerank_score", 6)), F.col(place)]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where((F.col("rank") <= keep) | ~many).drop("_n")


def _all(by: list[str]):
    return Window.partitionBy(*by)
