"""Working tables in the folder that the cluster shares, and ordered splitting of a table by a key."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a session on one machine (local[...]) gets one
    under /tmp; any other is refused, as machines that do not share a folder would each keep a part of a table."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file:///tmp/checkpoints"
    return found if "://" in found else f"file://{found}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# The writer of Parquet looks at its buffers every 100 rows at first; rows of some MB each have to be looked at one by one.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Write df as a working table in the shared folder and read it back: (table, place). Cuts the lineage, and
    survives lost executors. With WIDE_ROWS a row group closes with the row that fills it."""
    spark, place = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.options(**(options or {})).option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place), place


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has (Spark does not tell capitals from small letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT = 1000


def joined_hot(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """many left joined to few, which has one row a key. Keys that more than one in HOT of many's rows have (fewer than
    HOT keys, so they are broadcast) are dealt over salted copies of few's row. many is read twice: a stored table."""
    n_salts = partitions(many.sparkSession)
    total = many.count()
    hot, salt = fresh(many, "hot", "salt")
    counted = many.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > total).select(key, F.lit(True).alias(hot))
    salts = F.sequence(F.lit(0), F.lit(n_salts - 1))
    dealt = many.join(F.broadcast(counted), key, "left").withColumn(salt, F.when(F.col(hot), F.floor(F.rand(7) * n_salts).cast("int")).otherwise(0))
    copies = few.join(F.broadcast(counted), key, "left").withColumn(salt, F.explode(F.when(F.col(hot), salts).otherwise(F.array(F.lit(0)))))
    return dealt.drop(hot).join(copies.drop(hot), [key, salt], "left").drop(salt)


def joined(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """joined_hot where some key is hot, else a plain left join, whose plan and broadcasts cost the driver less. many is
    a stored table."""
    total, most = many.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    return joined_hot(many, few, key) if total and most * HOT > total else many.join(few, key, "left")


BITS = 1 << 23  # 1 MB


def maybe_in(rows: DataFrame, few: DataFrame, key: str, n_bits: int = BITS) -> DataFrame:
    """The rows whose key few has, and some others: a Bloom filter with two bits a key, sent to every task. Its size does
    not follow the input; with more keys more other rows pass, so a join has to come after it. n_bits: a power of 2."""
    (bits,) = fresh(rows, "bits")

    def places(k):
        h = F.xxhash64(k)
        return [h.bitwiseAND(F.lit(n_bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(n_bits - 1))]

    def inner(at):  # the place within its word
        return at.bitwiseAND(F.lit(63)).cast("int")

    set_ = few.select(F.explode(F.array(*places(F.col(key)))).alias("at")).select(F.shiftright("at", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), inner(F.col("at"))).alias("b"))
    words = set_.unionByName(few.sparkSession.range(n_bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("b"))).groupBy("word").agg(F.bit_or("b").alias("b"))
    table = words.agg(F.array_sort(F.collect_list(F.struct("word", "b"))).alias("words")).select(F.col("words.b").alias(bits))

    def is_set(at):
        word = F.element_at(F.col(bits), (F.shiftright(at, 6) + 1).cast("int"))
        return F.call_function("shiftrightunsigned", word, inner(at)).bitwiseAND(F.lit(1)) == 1

    first, second = places(F.col(key))
    return rows.join(F.broadcast(table), is_set(first) & is_set(second), "left_semi")


def split_points(df: DataFrame, key: str, n: int, accuracy: float = 0.2) -> list[float]:
    """At most n - 1 ascending values of a numeric key that split df into parts of about equal numbers of rows.
    They come from a quantile sketch over every row; it stays a few KB for any number of rows. TypeError for a key
    that is not numeric."""
    if not isinstance(df.schema[key].dataType, NumericType):
        raise TypeError(f"{key} has to be numeric")
    if n < 2:
        return []
    found = df.select(F.col(key).cast("double").alias("k")).where("k is not null").approxQuantile("k", [i / n for i in range(1, n)], accuracy / n)
    return sorted(set(found))


def with_part(df: DataFrame, key: str, points: list[float], to: str) -> DataFrame:
    """Adds column `to`: the number of split points at or below the key (0 for a null key). Ordered like the key."""
    if not points:
        return df.withColumn(to, F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *points, float("inf")], inputCol="_key_d", outputCol="_part_d", handleInvalid="keep")
    out = cut.transform(df.withColumn("_key_d", F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))))
    return out.withColumn(to, F.col("_part_d").cast("int")).drop("_key_d", "_part_d")


# --- Python workers: they are kept for later stages, so what a stage holds has to be given back


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in order, each with up to `most` bytes in that column (one row at least)."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(length.to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def trimmed(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker returns free memory to the system."""

    @wraps(run)
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return whole
