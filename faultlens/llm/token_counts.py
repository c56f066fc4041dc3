"""Document and token counts of flat, unindexed token files, by scanning for separators.

A file is nothing but ids (little-endian, 2 or 4 bytes), each document closed by an end id. Files are cut into blocks
of block_bytes that are searched in parallel; a block knows its separators, but not where its first document began.
A prefix scan over the blocks of a file (number of separators so far, end of the last one) gives each block its
carry, and a second one over files (in runs of FILES files, then over the runs) the numbers over the whole folder. No
task holds more than a block, however long a document is.

Results: ids behind the last separator of a file are a document too, with closed = false (none if there are no such
ids); two separators in a row enclose an empty document; a file that ends inside an id is rejected with ValueError;
an empty folder gives an empty result. Writing: a null text counts as empty; repeated rows are written each, null
doc_ids too; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.llm import bpe
from faultlens.llm.files import Input, Output, listing
from faultlens.llm.shared import by_bytes, new_folder, stored, trimmed

BLOCK_BYTES = 4 << 20
FILES = 1024


def write_flat(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, folder: str | None = None, width: int = 2) -> tuple[str, DataFrame]:
    """Encode docs with a byte-level BPE into flat files, one for each partition of docs: (folder, contents), where
    contents has file, nth, doc_id, the order in which documents were written."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "flat-tokens")
    ranks = bpe.read_ranks(vocabulary)
    if max([end_id, *ranks.values()]) >= 1 << (8 * width):
        raise ValueError(f"ids do not fit into {width} bytes")
    source = spark.sparkContext.broadcast((ranks, pattern))
    key = f"{vocabulary} {pattern}"
    end = np.array([end_id], dtype=f"<u{width}").tobytes()

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, out, nth = bpe._codec(key, source), None, 0
        name = f"part-{TaskContext.get().partitionId():06d}.bin"
        for batch in by_bytes(batches, "text", bpe.STEP):
            for text in batch.column("text").to_pylist():
                out = out or Output(f"{folder}/{name}")
                out.write(np.frombuffer(codec.encode(text), dtype="<u4").astype(f"<u{width}").tobytes() + end)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(nth, nth + n), pa.int64()), batch.column("doc_id")], ["file", "nth", "doc_id"])
            nth += n
        if out is not None:
            out.close()

    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    contents, _ = stored(base.mapInArrow(run, f"file string, nth long, doc_id {base.schema['doc_id'].dataType.simpleString()}"), "flat-contents")
    return folder, contents


def scan(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES, ends: str = ".bin") -> DataFrame:
    """file, nth (document in the file), nth_overall (files in order of name), start (first id in the file), n_tokens
    (without the separator), closed."""
    files = listing(folder, ends)
    if any(size % width for _, size in files):
        raise ValueError("a file ends inside an id")
    schema = "file string, nth long, nth_overall long, start long, n_tokens long, closed boolean"
    if not files:
        return spark.createDataFrame([], schema)
    step = block_bytes // width * width
    listed = spark.createDataFrame([(i, uri.rpartition("/")[2], uri, size) for i, (uri, size) in enumerate(files)], "f int, file string, uri string, bytes long")
    n_blocks = sum(-(-size // step) for _, size in files)
    blocks = (
        listed.where("bytes > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step))))
        .repartition(max(1, min(n_blocks, 10_000)))
    )

    @trimmed
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                uri, block = row.column("uri")[0].as_py(), row.column("block")[0].as_py()
                file = Input(uri)
                ids = np.frombuffer(file.read(block * step, step), dtype=f"<u{width}")
                file.close()
                at = np.flatnonzero(ids == end_id) + block * step // width
                found = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([len(ids)], pa.int64()), found], [*row.schema.names, "n_ids", "at"])

    kind = "f int, file string, uri string, bytes long, block long"
    found, _ = stored(blocks.mapInArrow(search, f"{kind}, n_ids long, at array<long>"), "separators")
    # prefix scans over small rows: one a block, then one a file
    before = Window.partitionBy("f").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("at") > 0, F.element_at("at", -1) + 1)
    carried = found.select("f", "block", F.size("at").cast("long").alias("n"), last.alias("last"), F.col("bytes")).withColumns(
        {"first_nth": F.coalesce(F.sum("n").over(before), F.lit(0)), "open": F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(0))}
    )
    per_file = carried.groupBy("f").agg(
        F.sum("n").alias("n"), F.coalesce(F.max("last"), F.lit(0)).alias("tail"), (F.max("bytes") / width).cast("long").alias("n_ids")
    ).withColumn("open_end", F.col("tail") < F.col("n_ids"))
    # over files in two levels: inside runs of FILES files, and over the runs
    held = per_file.select("f", F.floor(F.col("f") / FILES).alias("run"), (F.col("n") + F.col("open_end").cast("long")).alias("n"))
    runs = held.groupBy("run").agg(F.sum("n").alias("n"))
    runs = runs.select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("run_base"))
    inner = Window.partitionBy("run").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    files_ = held.withColumn("inner_base", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(runs, "run").select("f", (F.col("run_base") + F.col("inner_base")).alias("base"))
    begins = F.concat(F.array("open"), F.transform(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda x: x + 1))
    inside = (
        found.join(carried.select("f", "block", "first_nth", "open"), ["f", "block"])
        .where(F.size("at") > 0)
        .select("f", "file", "first_nth", F.posexplode(F.arrays_zip(begins.alias("b"), F.col("at").alias("e"))))
        .select("f", "file", (F.col("first_nth") + F.col("pos")).alias("nth"), F.col("col.b").alias("start"), (F.col("col.e") - F.col("col.b")).alias("n_tokens"), F.lit(True).alias("closed"))
    )
    tails = listed.join(per_file.where("open_end"), "f").select("f", "file", F.col("n").alias("nth"), F.col("tail").alias("start"), (F.col("n_ids") - F.col("tail")).alias("n_tokens"), F.lit(False).alias("closed"))
    return inside.unionByName(tails).join(files_, "f").select("file", "nth", (F.col("base") + F.col("nth")).alias("nth_overall"), "start", "n_tokens", "closed")


def read_flat(uri: str, width: int = 2) -> np.ndarray:
    """All ids of one file."""
    file = Input(uri)
    return np.frombuffer(file.read(0, file.size), dtype=f"<u{width}")


def count_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, file, nth, start, n_tokens: docs written to flat files and counted from them."""
    folder, contents = write_flat(docs, vocabulary, pattern, end_id)
    found = scan(docs.sparkSession, folder, end_id, block_bytes=block_bytes)
    return found.join(contents, ["file", "nth"]).select("doc_id", "file", "nth", "start", "n_tokens")


