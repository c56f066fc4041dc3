"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.llm import alignment, bpe, exact_dedup, fingerprints, mixing, ngram_join, periodic, pfor, sharding, surrogates, token_counts, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_documents(spark, sf_dir))


def op2_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir)
    return token_counts.count_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50256)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(_documents(spark, sf_dir)).select("doc_id", "text", "n_entities", "kinds")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_documents(spark, sf_dir))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, finish=bpe.digests)


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_documents(spark, sf_dir), n_shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def op8_patched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = pfor.write(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pfor.read_checksums(spark, folder)


def op9_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(_documents(spark, sf_dir))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "shards")


def op10_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = exact_dedup.groups(docs, exact_dedup.build_index(docs))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _with_period(doc_id: int | None, words: list[str]) -> list[str]:
    """Of a tenth of the texts, the words from some place on become a repeated stretch."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.detect(_documents(spark, sf_dir), periodic.digests, _with_period)


def op12_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    seconds = F.lit(946_684_800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))  # pages have no time of capture
    _, manifest = warc.write(pages, F.timestamp_seconds(seconds))
    return warc.histories(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents, _ = alignment.align(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_improbable_features": op1_improbable_features,
        "op2_separator_scan": op2_separator_scan,
        "op3_surrogates": op3_surrogates,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_toxicity_cnn": op5_toxicity_cnn,
        "op6_bpe_chunks": op6_bpe_chunks,
        "op7_virtual_slots": op7_virtual_slots,
        "op8_patched_blocks": op8_patched_blocks,
        "op9_mixing_tree": op9_mixing_tree,
        "op10_extendible_hash": op10_extendible_hash,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_index_merge": op12_index_merge,
        "op13_token_alignment": op13_token_alignment,
    }


_OP10 = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, points, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

# base32 of a SHA-1: every 5 hexadecimal digits are 4 letters
_OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 5 * (k // 4)::INT + 1, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_extendible_hash": _OP10, "op12_index_merge": _OP12}
