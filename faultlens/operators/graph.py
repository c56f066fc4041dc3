"""Threads, link tables and the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.session import checkpointed


def thread_roots(messages: DataFrame, key: str, parent: str) -> DataFrame:
    """key, root: the thread of every message by pointer jumping, so a chain of n replies takes log n rounds. A missing
    parent makes its child a root; members of a cycle, and what hangs on one, take the cycle's smallest key.

    After round r a message knows its ancestor 2**r steps up and the smallest key it met up to there. After log2(n)
    rounds, or when none moves any more, chains have come to their roots; any other message's ancestor stands on a
    cycle and has seen all of it."""
    known = messages.select(F.col(key).alias("_k")).distinct()
    hop = messages.select(F.col(key).alias("node"), F.col(parent).alias("up")).join(known, F.col("up") == F.col("_k"), "left").select("node", F.coalesce("_k", "node").alias("up"))
    hop = checkpointed(hop.select("node", "up", F.least("node", "up").alias("low"), (F.col("node") == F.col("up")).alias("top")))
    ahead = lambda: hop.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"), F.col("top").alias("top2"))
    for _ in range(hop.count().bit_length()):
        nxt = checkpointed(hop.join(ahead(), "up").select("node", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), "top", (F.col("up") != F.col("up2")).alias("moved")))
        hop = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    return hop.join(ahead(), "up").select(F.col("node").alias(key), F.when(F.col("top2"), F.col("up")).otherwise(F.col("low2")).alias("root"))


def link(refs: DataFrame, ref: str, index: DataFrame, index_key: str, link_type: str, confidence: float) -> DataFrame:
    """Typed edges from extracted references: source, target, link_type, confidence; one row an edge."""
    found = refs.join(index.select(F.col(index_key).alias(ref), F.col("target")), ref)
    return found.select("source", "target", F.lit(link_type).alias("link_type"), F.lit(confidence).alias("confidence")).distinct()


def property_graph(vertices: dict[str, tuple[DataFrame, str, list[str]]], edges: dict[str, tuple[DataFrame, str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """vertices: label -> (table, key, columns to keep as properties). (vertices: label, id, properties map; edges: relation, source_label, source, target_label, target). Edges keep
    only those with both ends, as a MATCH would."""
    v = None
    for label, (df, key, columns) in vertices.items():
        pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
        one = df.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), F.create_map(*pairs).alias("properties"))
        v = one if v is None else v.unionByName(one)
    e = None
    for relation, (df, s_label, s, t_label, t) in edges.items():
        one = df.select(F.lit(relation).alias("relation"), F.lit(s_label).alias("source_label"), F.col(s).cast("string").alias("source"), F.lit(t_label).alias("target_label"), F.col(t).cast("string").alias("target"))
        e = one if e is None else e.unionByName(one)
    for side in ("source", "target"):
        ends = v.select(F.col("label").alias(f"{side}_label"), F.col("id").alias(side))
        e = e.join(ends, [f"{side}_label", side], "left_semi")
    return v, e.select("relation", "source_label", "source", "target_label", "target")
