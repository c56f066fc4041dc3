"""What a task of the alignment holds stays that of a block, however many blocks a file or a shuffle partition has."""

import glob
from urllib.parse import urlparse

import public_tokenizers as P
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from faultlens.llm import alignment
from faultlens.llm.shared import WIDE_ROWS, stored


def test_wide_rows_are_written_in_small_groups(spark):
    wide = spark.range(40).repartition(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.xxhash64("id", i)).alias("v"))
    back, place = stored(wide, "wide-rows", WIDE_ROWS)
    assert back.count() == 40
    (file,) = glob.glob(f"{urlparse(place).path}/*.parquet")
    meta = pq.read_metadata(file)
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 16


def test_counts_reach_a_block_without_a_collected_list(spark):
    docs = spark.createDataFrame([(i, f"some words {i} of a text") for i in range(50)], "doc_id long, text string")
    documents, _ = alignment.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), step=200)
    plan = documents._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "collect_list" not in plan
    assert documents.count() == 50
