"""A table that upserts rewrite only in part: rows by key buckets, each bucket with a version, a manifest swapped last.

A batch reads and writes the buckets that its keys fall into; the files of all others stay as they are and keep their
names. Batches have ascending ids: one that was applied already changes nothing, so a repeated delivery does no
harm, and one that fails before its manifest is written leaves the table as it was. At most as many buckets as the table
was made with reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators.upsert import upsert

_MANIFEST = "batch long, buckets int, keys array<string>, schema string, versions map<int, long>"


class BucketedTable:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        row = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest/{max(_batches(spark, folder)):012d}").first()
        self.batch, self.buckets, self.keys, self.schema, self.versions = row["batch"], row["buckets"], row["keys"], row["schema"], row["versions"]

    @classmethod
    def create(cls, rows: DataFrame, keys: list[str], folder: str, buckets: int = 64) -> BucketedTable:
        """rows have to be one a key. Keys may be null."""
        spark = rows.sparkSession
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        touched = _written(rows, keys, buckets, f"{folder}/data/{0:012d}")
        _swap(spark, folder, (0, buckets, keys, schema, dict.fromkeys(touched, 0)))
        return cls(spark, folder)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        held = [b for b in self.versions if buckets is None or b in buckets]
        places = [f"{self.folder}/data/{self.versions[b]:012d}/_bucket={b}" for b in sorted(held)]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: int, new: DataFrame, overwrite: tuple[str, ...] = (), coalesce: tuple[str, ...] = (), union: tuple[str, ...] = ()) -> BucketedTable:
        """The table after new (one row a key) was upserted as by `upsert`; batch: its id, above 0."""
        if batch <= self.batch:
            return self
        place = f"{self.folder}/batches/{batch:012d}"
        _bucketed(new, self.keys, self.buckets).write.mode("overwrite").partitionBy("_bucket").parquet(place)  # read twice below
        rows = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(place)
        touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
        merged = upsert(self.read(touched), rows.drop("_bucket"), self.keys, overwrite, coalesce, union)
        _written(merged, self.keys, self.buckets, f"{self.folder}/data/{batch:012d}")
        _swap(self.spark, self.folder, (batch, self.buckets, self.keys, self.schema, self.versions | dict.fromkeys(touched, batch)))
        return BucketedTable(self.spark, self.folder)


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _written(rows: DataFrame, keys: list[str], buckets: int, place: str) -> list[int]:
    """Writes rows by bucket; the buckets that have any."""
    _bucketed(rows, keys, buckets).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(place)
    spark = rows.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return [r[0] for r in spark.read.schema(f"{schema}, _bucket int").parquet(place).select("_bucket").distinct().collect()]


def _swap(spark: SparkSession, folder: str, row: tuple) -> None:
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("error").parquet(f"{folder}/manifest/{row[0]:012d}")


def _batches(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return [int(n) for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest/{n}/_SUCCESS"))]
