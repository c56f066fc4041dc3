import re

import numpy as np
import pytest

from faultlens.llm import mixing as mx


def corpus(n=400):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        source = ["a", "b", "é", "z", None, "tiny"][int(rng.choice(6, p=[0.5, 0.2, 0.1, 0.1, 0.08, 0.02]))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 400))), source, "x"))
    return rows + [(7, "same same", "a", "x")] * 3 + [(None, "no id", "b", "x"), (900, None, "b", "x"), (901, "", "q", "x"), (902, "long " * 9000, "a", "x")]


def plain_targets(sizes):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e12
    for _ in range(300):  # one water level for all sources
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * w[s]) for s in order) < 1.5 * sum(sizes.values()) else (low, mid)
    return {s: min(2 * sizes[s], high * w[s]) for s in order}


@pytest.mark.parametrize("block", [64, 1024])
def test_quotas_are_exact(spark, block):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    documents, blocks = mx.mix(docs, n_shards=4, block_words=block, n_buckets=16)
    got = documents.collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(mx.WORD, t or ""))
    expected = plain_targets(sizes)
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert {round(r["target"], 3) for r in own} == {round(expected[s], 3)} and {r["source_size"] for r in own} == {sizes[s]}
        assert abs(sum(r["taken"] for r in own) - expected[s]) <= 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mx.mix(docs.repartition(5), n_shards=4, block_words=block, n_buckets=16)[0].collect()), key=str)
    cut = blocks.collect()
    assert sum(r["taken"] for r in cut) == sum(r["taken"] for r in got)
    keys = [(r["source"], r["doc_id"], r["copy"], r["pass"], r["block"], r["words"]) for r in cut]
    assert len(set(keys)) == len(keys)
    per = np.bincount([r["shard"] for r in cut], minlength=4)
    assert per.max() - per.min() <= 1 and len(per) == 4


def test_split_tree_keeps_all_counts():
    rng = np.random.default_rng(2)
    for n in (1, 3, 16):
        blocks = rng.integers(0, 1000, 7)
        out = mx.split_tree(blocks, n, rng)
        assert (out.sum(axis=1) == blocks).all() and (out >= 0).all() and np.ptp(out.sum(axis=0)) <= 1


def test_splits_have_the_hypergeometric_law():
    """The draw for large numbers, made to run on small ones too, against exact probabilities."""
    from math import comb

    class Small:  # a generator that refuses numpy's own draw
        def __init__(self, seed):
            self.random = np.random.default_rng(seed).random

    rng = np.random.default_rng(2)
    for good, bad, n in ((3_000_000_000, 1_000_000_000, 2_000_000_000), (5, 4_000_000_000, 3_000_000_000), (2_000_000_000, 3, 1_999_999_999)):
        for _ in range(20):
            x = mx._hypergeometric(rng, good, bad, n)
            sd = (n * good / (good + bad) * bad / (good + bad)) ** 0.5
            assert max(0, n - bad) <= x <= min(good, n) and abs(x - n * good / (good + bad)) <= 8 * sd + 1
    scale = 1_000_000_000  # one rare kind among many: the law is that of a few draws
    draws = [mx._hypergeometric(Small(s), 4, scale, scale // 4) for s in range(4000)]
    for k in range(5):
        assert abs(draws.count(k) / 4000 - comb(4, k) * 0.25**k * 0.75 ** (4 - k)) < 0.03


def test_every_node_of_the_tree_is_met_exactly():
    """Quotas by node, re-derived from the leaves: halves of the shards hold the halves' blocks, source by source."""
    blocks = np.array([5000, 1, 0, 333, 77_777])
    out = mx.split_tree(blocks, 16, np.random.default_rng(3))
    total = blocks.sum()
    for a, b in ((0, 16), (0, 8), (8, 16), (4, 8), (12, 14), (15, 16)):
        assert out[:, a:b].sum() == total * b // 16 - total * a // 16
    assert (out.sum(axis=1) == blocks).all() and abs(out[4, :8].sum() / 77_777 - 0.5) < 0.02


def test_whole_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    documents, _ = mx.mix(docs, block_words=None)
    times = {}
    for r in documents.collect():
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        times[(r["doc_id"], r["size"])] = times.get((r["doc_id"], r["size"]), 0) + (r["taken"] // r["size"] if r["size"] else 0)
    out = mx.mixed(docs)
    assert out.columns == docs.columns
    found = {}
    for r in out.collect():
        key = (r["doc_id"], len((r["text"] or "").split()))
        found[key] = found.get(key, 0) + 1
    assert found == {k: v for k, v in times.items() if v}


def test_shards_reach_the_results(spark):
    docs = spark.createDataFrame(corpus(100), "doc_id long, text string, source string, size string")
    documents, blocks = mx.mix(docs, block_words=None)
    dealt = {}
    for r in blocks.collect():
        dealt.setdefault((r["source"], r["doc_id"], r["size"], r["copy"]), set()).add(r["shard"])
    for r in documents.collect():
        assert r["shards"] == sorted(dealt.get((r["source"], r["doc_id"], r["size"], r["copy"]), set()))
    order = [r["doc_id"] for r in sorted(blocks.collect(), key=lambda r: (r["shard"], r["place"]))]
    assert [r["doc_id"] for r in mx.mixed(docs).collect()] == order


def test_columns_with_clashing_names(spark):
    rows = [(d, t, s, "p", 1, 2) for d, t, s, _ in corpus(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string, _id int, shard int")
    plain = mx.mixed(docs.select("doc_id", "text", "source")).collect()
    got = mx.mixed(docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.collect()] == [(*r, "p", 1, 2) for r in plain]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mx.mix(docs)[0].collect() == [] and mx.mixed(docs).collect() == []
