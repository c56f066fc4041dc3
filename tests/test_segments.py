"""An index in segments against plain searches over the documents as they are after each change."""

import random

import pytest
from pyspark.sql import functions as F

from faultlens.plans import search, segments
from faultlens.plans.segments import SegmentIndex

WORDS = ["leak", "tcp", "rare0"]


def documents(n, seed=1):
    rng = random.Random(seed)
    common = ["tcp", "leak", "net", "fs", "Lock"]
    rows = []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(300)}" for _ in range(rng.randrange(40))]
        if rng.random() < 0.02:
            words += [f"rare{rng.randrange(3)}"] * rng.randrange(1, 4)
        rows.append((i, " ".join(words) if i % 17 else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, body string")


def same(index, rows, spark, words=WORDS, k=15):
    docs = frame(spark, rows)
    want = {r["id"]: (r["matched"], round(r["score"], 6)) for r in search.bm25(docs, "id", "body", words).collect()}
    got = {r["id"]: (r["matched"], round(r["score"], 6)) for r in index.bm25(words).collect()}
    assert got == want
    top = [(r["id"], r["score"]) for r in index.top_k(words, k).collect()]
    assert top == sorted(((i, s) for i, (_, s) in want.items()), key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('segments')}"


def files(folder):
    import pathlib

    root = pathlib.Path(folder.removeprefix("file://"))
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet") if p.is_file()}


def test_changes_in_steps(spark, folder, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 2)
    rows = dict(documents(600))
    index = SegmentIndex.write(frame(spark, list(rows.items())), "id", "body", folder)
    same(index, rows.items(), spark)
    rng = random.Random(3)
    for step in range(2):
        changed = [(i, f"tcp leak leak {step} rare0") for i in rng.sample(sorted(rows), 20)] + [(1000 + 10 * step + j, "leak in net") for j in range(5)]
        gone = rng.sample(sorted(set(rows) - {i for i, _ in changed}), 15)
        before = files(folder)
        old = index
        index = index.update(frame(spark, changed), frame(spark, [(i, None) for i in gone]).select("id"), merge=False)
        assert before.items() <= files(folder).items()  # nothing is rewritten
        earlier = dict(rows)
        rows.update(changed)
        for i in gone:
            del rows[i]
        same(index, rows.items(), spark)
        assert SegmentIndex(spark, folder).version == index.version == old.version + 1
        if step == 0:
            same(SegmentIndex(spark, folder, old.version), earlier.items(), spark)
    assert len(index.segments) == 3 and sum(s.n_docs for s in index.segments) == len(rows)
    for j in range(2):
        index = index.update(frame(spark, [(5000 + j, "late leak")]))
        rows[5000 + j] = "late leak"
    assert len(index.segments) < 5  # small ones were merged
    same(index, rows.items(), spark)
    index.vacuum()
    same(SegmentIndex(spark, folder), rows.items(), spark)
    assert SegmentIndex(spark, folder).cover_rank(["tcp", "leak"]).count() == search.cover_rank(frame(spark, rows.items()), "id", "body", ["tcp", "leak"]).count()


def test_top_k_opens_few_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "the " * rng.randrange(1, 4) + "filler " * rng.randrange(30, 60)) for i in range(12_000)]
    for i in range(6000, 6012):
        rows[i] = (i, "the the needle")
    docs = frame(spark, rows).repartition(4)
    monkeypatch.setattr(segments, "SLICE_DOCS", 4000)
    index = SegmentIndex.write(docs, "id", "body", f"file://{tmp_path}/i")
    assert index.segments[0].slices == 3
    found, kept = index.opened(["the", "needle"], 10)
    want = search.bm25(docs, "id", "body", ["the", "needle"]).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in want.collect()]
    read, every = kept.agg(F.sum("n")).first()[0], index.postings(["the", "needle"]).count()
    assert read < 0.3 * every
    monkeypatch.setattr(segments, "PUSHED", 0)
    assert [tuple(r) for r in index.top_k(["the", "needle"], 10).collect()] == [tuple(r) for r in want.collect()]


def test_stop_words_stems_and_keys_of_text(spark, tmp_path):
    docs = spark.createDataFrame([("a", "the leaks are leaking"), ("b", "the the the"), ("c", None), (None, "leak")], "id string, body string")
    index = SegmentIndex.write(docs, "id", "body", f"file://{tmp_path}/i", stem=True, stop=["the", "are"])
    assert {(r["id"], r["term"], r["tf"], tuple(r["positions"])) for r in index.all.collect()} == {("a", "leak", 2, (1, 3))}
    assert [r["id"] for r in index.top_k(["the", "leaked"], 5).collect()] == ["a"] and index.stats.first()["n_docs"] == 3
    assert index.top_k(["the"], 5).collect() == [] == index.top_k(["none"], 5).collect()
    assert index.update(deleted=docs.select("id")).top_k(["leak"], 5).collect() == []
    empty = SegmentIndex.write(docs.limit(0), "id", "body", f"file://{tmp_path}/e")
    assert empty.segments == [] and empty.bm25(["leak"]).collect() == [] == empty.top_k(["leak"], 3).collect()
    assert [r["id"] for r in empty.update(docs).top_k(["leaks"], 3).collect()] == ["a"]
