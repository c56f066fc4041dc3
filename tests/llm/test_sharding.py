import random
import zlib

import pytest
from pyspark.sql import functions as F

from faultlens.llm import sharding as sh
from faultlens.llm.shared import new_folder


def corpus(n=600):
    rng = random.Random(2)
    rows = [(i - 50, "é" * rng.randint(0, 400), "k", 1) for i in range(n)]
    return rows + [(n, None, "k", 1), (n + 1, "", "k", 1), (None, "no id", "k", 1), (5, "twice", "k", 1), (5, "twice", "k", 1), (n + 2, "x" * 20_000, "k", 1)]


def test_sizes_are_near_equal_and_slots_gapless(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    place = new_folder(spark, "slot-map")
    got = sh.shard(docs, n_shards=5, n_slots=512, place=place).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    total = [sum(r["size"] for r in got if r["shard"] == k) for k in range(5)]
    assert max(total) - min(total) <= 2
    for k in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    maps = [sh.SlotMap.load(spark, place, v) for v in (1, 2)]
    assert maps[0].shard_of == sh.SlotMap.first(512, 5).shard_of
    assert all(maps[1].shard_of[r["virtual_slot"]] == r["shard"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, sh.shard(docs.repartition(7), n_shards=5, n_slots=512).collect()), key=str)


def test_assignment_matches_brute_force(spark):
    """Rows by their virtual slot's shard in the stored map, numbered in order; loads re-derived slot by slot."""
    rows = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")
    place = new_folder(spark, "slot-map")
    got = sh.shard(docs, n_shards=4, n_slots=64, place=place).collect()
    stored = spark.read.parquet(f"{place}/version=2").collect()
    shard_of, before = {r["virtual_slot"]: r["shard"] for r in stored}, {r["virtual_slot"]: r["moved_from"] for r in stored}
    assert all(k == (s % 4 if before[s] is None else shard_of[s]) and before[s] in (None, s % 4) for s, k in shard_of.items())
    slot_of = {r["d"]: r["s"] for r in docs.select(F.col("doc_id").alias("d"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int").alias("s")).collect()}
    sized = sorted((slot_of[d], d is None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, _, _ in rows)
    seen, expected = [0] * 4, []
    for s, none, d, crc, size in sized:
        expected.append((None if none else d, size, crc, shard_of[s], seen[shard_of[s]], s, 2))
        seen[shard_of[s]] += 1
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_a_stored_map_is_edited_not_made_anew(spark):
    place = new_folder(spark, "slot-map")
    few = spark.createDataFrame(corpus(50), "doc_id long, text string, shard string, slot int")
    many = spark.createDataFrame(corpus(300), "doc_id long, text string, shard string, slot int")
    sh.shard(few, n_shards=4, n_slots=64, place=place)
    assert {r["map_version"] for r in sh.shard(many, n_shards=4, n_slots=64, place=place).collect()} == {3}
    second, third = sh.SlotMap.load(spark, place, 2), sh.SlotMap.load(spark, place, 3)
    load, _ = sh.slot_loads(sh.with_slot(many, 64), 64)
    assert third == second.rebalanced(load) and sh.SlotMap.latest(spark, place) == third
    with pytest.raises(ValueError, match="stored map"):
        sh.shard(few, n_shards=5, n_slots=64, place=place)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_map_edits(seed):
    rng = random.Random(seed)
    load = [int(rng.paretovariate(1.2) * 100) if rng.random() < 0.9 else 0 for _ in range(400)]
    first = sh.SlotMap.first(400, 8)
    second = first.rebalanced(load)
    sums = lambda m: [sum(w for w, k in zip(load, m.shard_of, strict=True) if k == j) for j in range(m.n_shards)]
    assert max(sums(second)) - min(sums(second)) <= max(2, max(load) - (sum(load) - max(load)) / 7 + 1)
    assert second.version == 2 and all(first.shard_of[s] == a and second.shard_of[s] == b for s, a, b in second.edits)
    third = second.grown(load)
    assert third.n_shards == 9 and all(b in (a, 8) for a, b in zip(second.shard_of, third.shard_of, strict=True))
    assert sums(third)[8] <= sum(load) / 9


def test_empty_table(spark):
    assert sh.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
