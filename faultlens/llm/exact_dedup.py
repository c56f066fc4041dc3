"""Exact deduplication with an extendible-hash index kept as shared files. DataFrame operations only.

The 64-bit key of a text is the hash of its normalised form (space and 0x09-0x0D deleted). Texts of one key are told
apart by comparing the normalised bytes themselves (a grouping on key and bytes, combined on the map side, so that a
group of copies that holds a third of all rows reaches its owner as one row a task). A directory over the leading key
bits says which bucket holds an entry: it doubles until its slots are within capacity, and slots whose entries fit
into one bucket share it; its depth follows from the data. Owner tasks take contiguous key ranges and write their
buckets in order; entries of one key follow each other as a chain. Rows find their entry through the directory.

Results: null text counts as empty, and empty texts are equal to each other; of equal texts the row with most code
points, then the smallest doc_id (null last) is kept; of rows repeated as a whole one is kept; an empty table gives
an empty result. Columns besides doc_id and text are not read, whatever their names, and `deduplicated` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.llm.shared import delete, fresh, new_folder, partitions

SPACE = " \t\n\x0b\x0c\r"
MOST_BITS = 48
HOT = 1000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, code points of the original, normalised text, its 64-bit key and its SHA-256."""
    return (
        docs.select(F.col("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n_points"), normalised(F.col("text")).alias("norm"))
        .withColumn("key", F.xxhash64("norm"))
        .withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    )


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth)


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """slot, bucket (its first slot), local_depth, global_depth for the keys (a column `key`).

    The directory doubles until no slot that can be split is over capacity. Then a bucket is the largest aligned block
    of slots within capacity: counts of all blocks of all depths come from one grouping, and a block within capacity
    is a bucket where the block of twice its width is not."""
    spark = keys.sparkSession
    depth = max(1, (keys.count() // capacity).bit_length())
    while True:
        counts = keys.groupBy(_slot(depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"), (F.min("key") != F.max("key")).alias("splits"))
        if depth == MOST_BITS or counts.where((F.col("n") > capacity) & F.col("splits")).isEmpty():
            break
        depth += 1
    slots = spark.range(1 << depth).withColumnRenamed("id", "slot").join(counts, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))
    blocks = (
        slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("local_depth"))
        .groupBy("local_depth", F.expr(f"shiftrightunsigned(slot, {depth} - local_depth)").alias("prefix"))
        .agg(F.sum("n").alias("n"))
    )
    over = blocks.where(F.col("n") > capacity).select((F.col("local_depth") + 1).alias("local_depth"), F.col("prefix").alias("parent"))
    fit = blocks.where((F.col("n") <= capacity) | (F.col("local_depth") == depth)).withColumn("parent", F.shiftrightunsigned("prefix", 1))
    buckets = fit.where("local_depth = 0").unionByName(fit.join(over, ["local_depth", "parent"], "left_semi").select(*fit.columns))
    first, past = (F.expr(f"shiftleft({p}, {depth} - local_depth)") for p in ("prefix", "prefix + 1"))
    return buckets.select(F.explode(F.sequence(first, past - 1)).alias("slot"), first.alias("bucket"), "local_depth", F.lit(depth).alias("global_depth"))


def build_index(docs: DataFrame, capacity: int = 20_000, place: str | None = None) -> str:
    """Write the index of docs and return its folder: entries/ (bucket, key, chain, text_sha256, keep_id,
    keep_points, group_size; files hold ascending bucket ranges) and directory/ (slot, bucket, local_depth,
    global_depth)."""
    spark: SparkSession = docs.sparkSession
    place = place or new_folder(spark, "dedup-index")
    entries = (
        keyed(docs)
        .groupBy("key", "norm", "text_sha256")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.min(F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"))).alias("best"),
        )
        .select("key", "text_sha256", F.col("best.doc_id").alias("keep_id"), (-F.col("best.p")).alias("keep_points"), "group_size")
    )
    entries.write.option("compression", "zstd").parquet(f"{place}/loose")
    loose = spark.read.schema(entries.schema).parquet(f"{place}/loose")
    directory(loose.select("key"), capacity).write.parquet(f"{place}/directory")
    slots, depth = _directory(spark, place)
    collided = loose.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("text_sha256")) - 1
    chains = loose.join(collided, "key", "left_semi").select("key", "text_sha256", nth.alias("chain"))
    owned = (
        loose.join(chains, ["key", "text_sha256"], "left")
        .withColumn("chain", F.coalesce("chain", F.lit(0)))
        .withColumn("slot", _slot(depth))
        .join(slots, "slot")
        .drop("slot")
    )
    ranges = owned.repartitionByRange(partitions(spark), "bucket", "key").sortWithinPartitions("bucket", "key", "chain")
    ranges.write.option("compression", "zstd").parquet(f"{place}/entries")
    delete(spark, f"{place}/loose")
    return place


def _directory(spark: SparkSession, index: str) -> tuple[DataFrame, int]:
    """(slot, bucket; global depth). Joined as Spark sees fit for its size, about two slots for `capacity` texts."""
    found = spark.read.schema("slot long, bucket long, local_depth int, global_depth int").parquet(f"{index}/directory")
    return found.select("slot", "bucket"), found.first()["global_depth"]


def groups(docs: DataFrame, index: str) -> DataFrame:
    """One row per row of docs: doc_id, n_points, keep_id, group_size, kept, text_sha256, bucket, chain.

    A row's key leads to a slot, the slot to a bucket, and in the bucket it meets the entries of its key; which of a
    chain is its own its SHA-256 tells (the bytes were compared when the index was built). A text that more than one
    row in HOT holds has its entry in every one of a row of salted copies."""
    spark = docs.sparkSession
    entries = spark.read.parquet(f"{index}/entries")
    slots, depth = _directory(spark, index)
    total = entries.agg(F.sum("group_size")).first()[0] or 0
    hot = entries.where(F.col("group_size") * HOT > total).select("key", "text_sha256", F.lit(True).alias("hot"))  # fewer than HOT rows
    n_salts = partitions(spark)
    salted = entries.join(F.broadcast(hot), ["key", "text_sha256"], "left").withColumn(
        "salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(n_salts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("hot")
    rows = keyed(docs).groupBy("key", "text_sha256", "doc_id", "n_points").agg(F.count(F.lit(1)).alias("copies"))
    routed = (
        rows.join(F.broadcast(hot), ["key", "text_sha256"], "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "n_points"), F.lit(n_salts)).cast("int")).otherwise(0))
        .withColumn("slot", _slot(depth))
        .join(slots, "slot")
        .drop("slot", "hot")
    )
    found = routed.join(salted, ["bucket", "key", "text_sha256", "salt"])
    out = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")) & (F.col("copy") == 1)
    return out.select("doc_id", "n_points", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "bucket", "chain")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    hashed, points = fresh(docs, "hash", "points")
    kept = groups(docs, build_index(docs, **options)).where("kept").select(F.col("doc_id").alias("_id"), F.col("n_points").alias("_n"), F.col("text_sha256").alias("_h"))
    own = docs.withColumn(hashed, F.sha2(normalised(F.col("text")).cast("binary"), 256)).withColumn(points, F.coalesce(F.length("text"), F.lit(0)))
    same = own["doc_id"].eqNullSafe(kept["_id"]) & (own[hashed] == kept["_h"]) & (own[points] == kept["_n"])
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", hashed, points]).select(*docs.columns)
