"""Top-n, first-row, normalising and run-length operators over windows. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= n)


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """DISTINCT ON."""
    return top_n(df, by, order, 1).drop("rn")


def max_normalised(df: DataFrame, by: str, score: str) -> Column:
    """score over its group's largest; a largest of 0 counts as 1."""
    top = F.max(score).over(Window.partitionBy(by))
    return F.col(score) / F.when(top == 0, F.lit(1)).otherwise(top)


def leading_run(df: DataFrame, by: str, order: list[Column], ends: Column) -> DataFrame:
    """Length of each group's run of rows before the first that `ends`, in the given order."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_seen", F.sum(ends.cast("int")).over(w)).groupBy(by).agg(F.sum((F.col("_seen") == 0).cast("long")).alias("run_length"))


def rank_score(by: list[str], order: list[Column]) -> Column:
    """1 for the first of n, falling by 1/n."""
    return 1 - (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def repeatable_sample(df: DataFrame, key: list[str], seed: int, n: int) -> DataFrame:
    """n rows in an order that depends on key and seed alone."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)
