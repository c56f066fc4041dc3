"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source has a target in words: its share, by weight, of `share` times all words; a target above `most` times
the source's words stops there and the excess is shared again by weight. Documents are cut into blocks of
block_words words. A source's quota is met by whole passes over its blocks and one partial pass, in which the first
blocks of a keyed permutation are drawn until the quota is used up (the last one in part). The exact block counts
of all sources are then split among the output shards by a binary tree: each node draws from a multivariate
hypergeometric distribution how many of its blocks of each source go left. A shard's part of a source is a run of
ranks of the permutation, so shards are disjoint; inside a shard blocks are put in keyed random order.

Scale: ranks come from sums over (source, pass, bucket of the permutation), and windows only span one bucket; a
source that holds a third of all rows is spread over all buckets. The driver sees sums by source only. It raises
ValueError for more than max_sources of them, as the plan by source is broadcast.

Results: words are `[^\\x20\\x09-\\x0D]+`; a null or empty text has size 0 and is not taken; a null source is a source
of its own and comes last; rows repeated as a whole are counted and drawn each by itself; an empty table gives an
empty result. The same input and seed give the same result. Columns besides doc_id, text and source are not read, and
`mixed` keeps them, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.shared import fresh, partitions, stored

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target words by source; sources in code point order, null last, have the weights of `cycle` in turn."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in order if s in open_ and unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def split_tree(blocks: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """(source, shard) block counts: rows sum to `blocks`, columns differ by one block at most in total."""
    total = int(blocks.sum())
    room = [total * (k + 1) // n_shards - total * k // n_shards for k in range(n_shards)]
    out = np.zeros((len(blocks), n_shards), dtype=np.int64)
    todo = [(0, n_shards, blocks.astype(np.int64))]
    while todo:
        a, b, own = todo.pop()
        if b - a == 1:
            out[:, a] = own
            continue
        mid = (a + b) // 2
        left, rest, n = np.zeros_like(own), int(own.sum()), sum(room[a:mid])
        for i, c in enumerate(own.tolist()):
            rest -= c
            left[i] = _hypergeometric(rng, c, rest, n)
            n -= int(left[i])
        todo += [(a, mid, left), (mid, b, own - left)]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw. Beyond numpy's range (1e9) by inversion over 20 standard deviations around the mean,
    outside of which a draw falls with a probability below 1e-80."""
    if good == 0 or n == 0:
        return 0
    all_ = good + bad
    if all_ < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(good, n)
    mean = n * (good / all_)
    reach = 20 * (mean * (bad / all_) * ((all_ - n) / max(1, all_ - 1))) ** 0.5 + 20
    low, high = max(low, int(mean - reach)), min(high, int(mean + reach))
    k = np.arange(high - low, dtype=np.float64)
    up = np.log(good - low - k) + np.log(n - low - k) - np.log(low + k + 1) - np.log(bad - n + low + k + 1)  # log p(k + 1) / p(k)
    p = np.concatenate(([0.0], np.cumsum(up)))
    p = np.cumsum(np.exp(p - p.max()))
    return low + int(np.searchsorted(p, rng.random() * p[-1], side="right").clip(0, high - low))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, copy: one row per row of docs; copy tells rows apart that are alike in the rest."""
    return (
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .drop("copies")
    )


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df cut by ranges of the keys and sorted: written files follow each other in the order of the keys."""
    return df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def mix(
    docs: DataFrame,
    n_shards: int = 16,
    block_words: int | None = 1024,
    seed: int = 17,
    cycle: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    n_buckets: int = 4096,
    max_sources: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks).

    documents: doc_id, source, size, copy, source_size, target, taken (words), shards (those that hold
    blocks of it), one row per row of docs; summed from the dealt blocks.
    blocks: source, doc_id, copy, size, pass, block (number in the document), words, taken, shard, place (sort key in the
    shard), one row per block drawn, stored by shard and place. block_words None makes each document one block, taken whole or not at all.
    """
    spark = docs.sparkSession
    sizes, _ = stored(sized(docs), "mix-sizes")
    per = F.greatest(F.col("size"), F.lit(1)) if block_words is None else F.lit(block_words)
    n_blocks = F.when(F.col("size") > 0, F.ceil(F.col("size") / per)).otherwise(0)
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.sum(n_blocks).alias("blocks")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    size, blocks = {r["source"]: r["size"] for r in found}, {r["source"]: r["blocks"] for r in found}
    target = targets(size, cycle, share, most)
    plan = []
    for s, t in target.items():
        quota = min(round(t), int(most * size[s]))
        passes, rest = divmod(quota, size[s]) if size[s] else (0, 0)
        plan.append((s, size[s], float(t), passes, rest, blocks[s]))
    plan.sort(key=lambda p: (p[0] is None, p[0] or ""))  # the tree draws in this order
    kind = "source string, source_size long, target double, passes int, rest long, source_blocks long"
    listing = spark.createDataFrame(plan, kind).coalesce(1)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    planned = sizes.join(F.broadcast(listing), same(sizes, listing)).drop(listing["source"])
    order = F.xxhash64(F.lit(seed), F.col("pass"), "source", "doc_id", "copy", "block")
    cut = (
        planned.where("size > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
        .where("pass < passes or rest > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / per) - 1).cast("int"))))
        .withColumn("words", F.least(per, F.col("size") - F.col("block") * per))
        .withColumn("order", order)
        .withColumn("bucket", F.pmod("order", F.lit(n_buckets)).cast("int"))
    )
    keys = ["source", "pass", "bucket"]
    before = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys)
        .agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
        .select(*keys, F.coalesce(F.sum("w").over(before), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("blocks_before"))
    )
    inside = Window.partitionBy(*keys).orderBy("order", "doc_id", "copy", "block")
    # windows come before the join: both work on the same partitioning by (source, pass, bucket)
    ranked = cut.withColumn("cum", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(inside))
    on = ranked["source"].eqNullSafe(starts["source"]) & (ranked["pass"] == starts["pass"]) & (ranked["bucket"] == starts["bucket"])
    placed = ranked.join(starts, on).select(ranked["*"], "words_before", "blocks_before")
    left = F.col("rest") - F.col("words_before") - F.col("cum") + F.col("words")
    part = F.when(left * 2 >= F.col("words"), F.col("words")).otherwise(0) if block_words is None else F.greatest(F.lit(0), F.least("words", left))
    drawn, _ = stored(
        placed.withColumn("taken", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(part))
        .where("taken > 0")
        .withColumn("rank", F.col("pass") * F.col("source_blocks") + F.col("blocks_before") + F.col("nth") - 1)
        .select("source", "doc_id", "copy", "size", "pass", "block", "words", "taken", "rank", "order"),
        "mix-drawn",
    )
    counts = {r["source"]: r["n"] for r in drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_sources rows at most
    names = [p[0] for p in plan]
    shares = split_tree(np.array([counts.get(s, 0) for s in names], dtype=np.int64), n_shards, np.random.default_rng(seed))
    ends = spark.createDataFrame(list(zip(names, np.cumsum(shares, axis=1).tolist(), strict=True)), "source string, ends array<long>").coalesce(1)
    shuffled = (
        drawn.join(F.broadcast(ends), same(drawn, ends))
        .drop(ends["source"])
        .withColumn("shard", F.expr("size(filter(ends, e -> e <= rank))"))
        .select("source", "doc_id", "copy", "size", "pass", "block", "words", "taken", "shard", F.xxhash64(F.lit(seed + 1), "shard", "order").alias("place"))
    )
    dealt, _ = stored(in_order(shuffled, "shard", "place", "source", "doc_id", "copy", "pass", "block"), "mix-dealt")
    by_doc = dealt.groupBy("source", "doc_id", "size", "copy").agg(F.sum("taken").alias("taken"), F.array_sort(F.collect_set("shard")).alias("shards"))
    on = planned["source"].eqNullSafe(by_doc["source"]) & planned["doc_id"].eqNullSafe(by_doc["doc_id"]) & (planned["size"] == by_doc["size"]) & (planned["copy"] == by_doc["copy"])
    documents = planned.join(by_doc, on, "left").select(
        planned["doc_id"], planned["source"], planned["size"], planned["copy"], "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"),
    )
    return documents, dealt


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, whole, as often as it takes them, with their columns; shard after shard,
    and in a shard by place."""
    documents, dealt = mix(docs, block_words=None, **options)
    size, shard, place, number = fresh(docs, "size", "shard", "place", "number")
    drawn = dealt.where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words"), F.col("copy").alias("_copy"),
        F.col("shard").alias(shard), F.col("place").alias(place),
    )
    own = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    alike, _ = stored(
        documents.where("copy > 1").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words")).distinct(), "mix-alike"
    )

    def same(left: DataFrame, right: DataFrame):
        return left["doc_id"].eqNullSafe(right["_id"]) & left["source"].eqNullSafe(right["_source"]) & (left[size] == right["_words"])

    single = drawn.where("_copy = 1")
    columns = [own[c] for c in docs.columns]
    if alike.isEmpty():
        chosen = own.join(single, same(own, single)).select(*columns, single[shard], single[place])
    else:  # rows alike in doc_id, source and size are numbered to tell them apart
        on = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & a["_source"].eqNullSafe(b["_source"]) & (a["_words"] == b["_words"])
        ones = single.join(alike, on(single, alike), "left_anti")
        many = drawn.join(alike, on(drawn, alike), "left_semi")
        order = Window.partitionBy("doc_id", "source", size).orderBy("text")
        numbered = own.join(alike, same(own, alike), "left_semi").withColumn(number, F.row_number().over(order))
        first = own.join(ones, same(own, ones)).select(*columns, ones[shard], ones[place])
        again = numbered.join(many, same(numbered, many) & (numbered[number] == many["_copy"]))
        chosen = first.unionByName(again.select(*[numbered[c] for c in docs.columns], many[shard], many[place]))
    return in_order(chosen, shard, place).select(*docs.columns)
