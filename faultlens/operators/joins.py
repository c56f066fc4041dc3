"""Join operators between entities and typed edges. All take DataFrames and column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing_keys(edges: DataFrame, key: str, dimension: DataFrame, dimension_key: str) -> DataFrame:
    """Distinct edge keys without a row in the dimension (NULL keys are no reference)."""
    keys = edges.where(F.col(key).isNotNull()).select(F.col(key).alias("missing")).distinct()
    return keys.join(dimension.select(F.col(dimension_key).alias("missing")), "missing", "left_anti")


def dangling_edges(edges: DataFrame, sides: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct edges of which at least one end is missing."""
    found = [edges.join(d.select(F.col(k).alias(c)), c, "left_anti").select(*edges.columns) for c, (d, k) in sides.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def lookup(refs: DataFrame, index: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched) references of an index. Spark broadcasts the index when its size allows."""
    return refs.join(index, keys), refs.join(index, keys, "left_anti")


def both_directions(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Every edge seen from both ends: node, other, direction."""
    out = edges.select(F.col(source).alias("node"), F.col(target).alias("other"), F.lit("forward").alias("direction"))
    back = edges.select(F.col(target).alias("node"), F.col(source).alias("other"), F.lit("backward").alias("direction"))
    return out.unionByName(back)


def resolve_prefixes(refs: DataFrame, ref: str, targets: DataFrame, target: str, shortest: int = 7) -> DataFrame:
    """refs joined to targets that start with the reference. An equality on the first `shortest` characters deals
    both sides by key; the rest of the reference is checked on the matches. References that are shorter match nothing."""
    left = refs.where(F.length(ref) >= shortest).withColumn("_head", F.substring(ref, 1, shortest))
    right = targets.withColumn("_head", F.substring(target, 1, shortest))
    return left.join(right, (left["_head"] == right["_head"]) & right[target].startswith(left[ref])).drop("_head")


def outer_merge(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer join of two scorers: the mean where both scored, else whichever did."""
    a, b = left.select(key, F.col(value).alias("a")), right.select(key, F.col(value).alias("b"))
    both = (F.col("a") + F.col("b")) / 2
    return a.join(b, key, "full_outer").select(key, "a", "b", F.coalesce(both, "a", "b").alias(value))


def merge_hits(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """Local and remote hits by key: the local body wins, the score is the larger one."""
    a, b = local.select(key, F.col("score").alias("sa"), F.col("body").alias("ba")), remote.select(key, F.col("score").alias("sb"), F.col("body").alias("bb"))
    return a.join(b, key, "full_outer").select(key, F.greatest("sa", "sb").alias("score"), F.coalesce("ba", "bb").alias("body"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """The latest right value at or before each left row's time, by union and a running last(); one shuffle."""
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(*by, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")


def glob_match(path: Column, pattern: str) -> Column:
    """MAINTAINERS-style globs: a trailing slash takes everything below, * takes any run of characters, slashes too;
    all else is literal."""
    quoted = "".join(".*" if c == "*" else f"\\Q{c}\\E" for c in pattern)
    return path.rlike(f"^{quoted}{'.*' if pattern.endswith('/') else ''}$")
