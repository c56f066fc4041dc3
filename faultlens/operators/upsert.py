"""Upserts without MERGE: old and new rows meet in one join, the result is the next version of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], overwrite: tuple[str, ...] = (), coalesce: tuple[str, ...] = (), union: tuple[str, ...] = ()) -> DataFrame:
    """On a key conflict: `overwrite` columns take the new value, `coalesce` columns the new one unless NULL, `union`
    arrays both; all others stay. New keys are added. new must have one row a key; applying it twice changes nothing."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.withColumn("_a", F.lit(True)).alias("a").join(b.withColumn("_b", F.lit(True)).alias("b"), on, "full_outer")
    had, has = F.col("a._a").isNotNull(), F.col("b._b").isNotNull()

    def pick(c: str):
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in overwrite:
            changed = y
        elif c in coalesce:
            changed = F.coalesce(y, x)
        elif c in union:
            changed = F.array_sort(F.array_union(F.coalesce(x, F.array().cast(old.schema[c].dataType)), F.coalesce(y, F.array().cast(old.schema[c].dataType))))
        else:
            changed = x
        return F.when(had & has, changed).when(had, x).otherwise(y).alias(c)

    return both.select(*[pick(c) for c in old.columns])


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new to append: keys not in old, one row a key."""
    return new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys)


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """change_type, n: how values differ between two versions ('' counts as none)."""
    joined = old.select(key, F.coalesce(value, F.lit("")).alias("was")).join(new.select(key, F.coalesce(value, F.lit("")).alias("now")), key)
    kind = F.when(F.col("was") == F.col("now"), "unchanged").when(F.col("was") == "", "new").when(F.col("now") == "", "cleared").otherwise("changed")
    return joined.groupBy(kind.alias("change_type")).agg(F.count(F.lit(1)).alias("n"))


def latest_checkpoint(runs: DataFrame, source: str, status: str, finished: str, checkpoint: str, tie: str) -> DataFrame:
    """The checkpoint of each source's latest successful run."""
    ok = runs.where(F.col(status) == "ok")
    best = F.max(F.struct(F.col(finished), F.col(tie), F.col(checkpoint).alias("checkpoint")))
    return ok.groupBy(source).agg(best.alias("b")).select(source, F.col("b.checkpoint").alias("checkpoint"))


def incremental(rows: DataFrame, seen: DataFrame, key: str, changed_at: str, watermark, again=None) -> DataFrame:
    """Rows past the watermark that are not in the seen set, or that `again` lets through."""
    fresh = rows.where(F.col(changed_at) > watermark) if watermark is not None else rows
    unseen = fresh.join(seen.select(key), key, "left_anti")
    return unseen if again is None else unseen.unionByName(fresh.where(again).join(seen.select(key), key, "left_semi"))


REMEMBERED = ("ok", "not_found", "server_error")


def outcome(status, error) -> Column:
    """What became of a request: ok, not_found, server_error, or transient, which is tried again."""
    return F.when(error.isNotNull(), "transient").when(status.between(200, 299), "ok").when(status.isin(404, 410), "not_found").when(status >= 500, "server_error").otherwise("transient")


def remembered(state: DataFrame, responses: DataFrame, key: str, result: str) -> DataFrame:
    """The next version of a table of ids and outcomes; transient outcomes are not kept."""
    return upsert(state, responses.where(F.col(result).isin(*REMEMBERED)), [key], overwrite=(result,))


def todo(wanted: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Ids that were asked for and have no remembered outcome, once each."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(state.select(key), key, "left_anti")


def rebuilt(df: DataFrame, folder: str) -> DataFrame:
    """A derived table made anew in place of what the folder held; df must not read from it."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
