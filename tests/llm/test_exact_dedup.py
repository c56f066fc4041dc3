import hashlib
import random
import re

import pytest

from faultlens.llm import exact_dedup as ed


def corpus():
    rng = random.Random(6)
    base = ["", " \t", None, "a b", "ab", "A b", "x" * 50_000, " y " * 9000, "é ", "é"] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(1, 8))) for _ in range(150)]
    rows = [(i, t, "k") for i, t in enumerate(base)] + [(1000 + i, "hot text" + " " * (i % 3), "k") for i in range(200)]
    return rows + [(3, "a b", "k"), (3, "a b", "k"), (None, "ab", "k"), (None, "only null", "k")]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, d))
    out, used = [], set()
    for d, t, _ in rows:
        best = min(groups[norm(t)])
        first = (d, len(t or "")) == (best[3], -best[0]) and norm(t) not in used
        if first:
            used.add(norm(t))
        out.append((d, best[3], len(groups[norm(t)]), first, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("capacity", [20_000, 5, 1])
def test_groups_match_brute_force(spark, capacity):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    index = ed.build_index(docs, capacity)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in ed.groups(docs, index).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    entries = spark.read.parquet(f"{index}/entries").collect()
    slots = {r["slot"]: r for r in spark.read.parquet(f"{index}/directory").collect()}
    depth = slots[0]["global_depth"]
    assert sorted(slots) == list(range(1 << depth))
    assert all(slots[(r["key"] % (1 << 64)) >> (64 - depth)]["bucket"] == r["bucket"] for r in entries)
    held = {}
    for r in entries:
        held[r["bucket"]] = held.get(r["bucket"], 0) + 1
    assert max(held.values()) <= capacity
    kept = ed.deduplicated(docs, capacity=capacity)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(((d, t) for (d, t, _), b in zip(rows, brute(rows), strict=True) if b[3]), key=str)


@pytest.mark.parametrize("capacity", [1, 3, 10, 1000])
def test_directory_is_that_of_an_extendible_hash(spark, capacity):
    """Against a plain one: buckets split one by one, the directory doubling where a bucket has its depth."""
    rng = random.Random(capacity)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(60)] + [rng.getrandbits(50) for _ in range(40)] + [7] * 12
    got = ed.directory(spark.createDataFrame([(k,) for k in keys], "key long"), capacity).collect()
    depth = got[0]["global_depth"]
    todo, expected = [("", [format(k % (1 << 64), "064b") for k in keys])], {}
    while todo:
        prefix, own = todo.pop()
        if len(own) > capacity and len(prefix) < depth:
            todo += [(prefix + bit, [k for k in own if k[len(prefix)] == bit]) for bit in "01"]
        else:
            first = int(prefix.ljust(depth, "0"), 2)
            expected |= {s: (first, len(prefix)) for s in range(first, first + (1 << (depth - len(prefix))))}
    assert {r["slot"]: (r["bucket"], r["local_depth"]) for r in got} == expected and len(got) == len(expected)


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5), (2, "ab", "y", 6)], "doc_id long, text string, _hash string, _points int")
    assert [tuple(r) for r in ed.deduplicated(docs).collect()] == [(1, "a b", "x", 5)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ed.groups(docs, ed.build_index(docs)).collect() == [] and ed.deduplicated(docs).collect() == []
