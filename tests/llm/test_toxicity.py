import random
import zlib

import numpy as np

from faultlens.llm import toxicity as tx


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    bad = ["vilestem" + s for s in ("en", "a", "ung", "os")] + ["rotten"]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(text), "en" if i % 3 else "de", toxic))
    return rows


def test_pooling_matches_a_plain_convolution():
    texts = [t.encode() for _, t, _, _ in corpus(12)] + [b"", b"one", b"two words"]
    rng = np.random.default_rng(0)
    m = tx._Trained(
        rng.normal(size=(tx.BUCKETS, tx.DIM)).astype(np.float32),
        [rng.normal(size=(w * tx.DIM, tx.FILTERS)).astype(np.float32) for w in tx.WIDTHS],
        [rng.normal(size=tx.FILTERS).astype(np.float32) for _ in tx.WIDTHS],
        rng.normal(size=len(tx.WIDTHS) * tx.FILTERS), 0.1,
    )
    buckets, first = tx.features(texts)
    best, where = m.pooled(buckets, first)
    for k in range(len(texts)):
        x = m.embedding[buckets[first[k] : first[k + 1]]].sum(axis=1)
        for i, w in enumerate(tx.WIDTHS):
            if not len(x):
                assert (best[k] == 0).all()
                continue
            padded = np.concatenate([x, np.zeros((w, tx.DIM), np.float32)])
            out = np.stack([np.maximum(padded[j : j + w].reshape(-1) @ m.filters[i] + m.offsets[i], 0) for j in range(len(x))])
            assert np.allclose(best[k, i * tx.FILTERS : (i + 1) * tx.FILTERS], out.max(axis=0), atol=1e-4)
    assert np.allclose(m.logits(texts, most=200), m.logits(texts), atol=1e-5)


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, l, 3) for d, t, l, _ in rows] + [(9001, None, None, 3), (9002, "", "en", 3), (None, "x", "en", 3), (9003, "a rotten day", "fr", 3), (9003, "a rotten day", "fr", 3)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(d, y) for d, _, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = tx.train(docs, labels, tx.TrainingBounds(600, 20_000))
    got = [r.asDict() for r in tx.score(docs, model).collect()]
    assert len(got) == len(rows) + 5
    truth = {d: y for d, _, _, y in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[9001]["score"] == by[9002]["score"] < 0.5 and by[9003]["predicted"] == 1
    kept = {r["doc_id"] for r in tx.accepted(docs, model).collect()}
    assert kept == {r["doc_id"] for r in got if not r["rejected"]}


def test_labels_of_one_kind_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in tx.score(docs, tx.train(docs, none)).collect()} == {0.0}
    assert tx.score(docs.limit(0), tx.train(docs.limit(0), none)).collect() == []


def test_cuts_match_a_plain_search():
    rng = np.random.default_rng(5)
    for _ in range(200):
        values = np.unique(rng.integers(-20, 20, 12)) / 4
        pos, neg = rng.integers(0, 4, (2, len(values)))
        if not pos.sum() or not neg.sum():
            continue
        loss = lambda cut: pos[values < cut].sum() / pos.sum() + neg[values >= cut].sum() / neg.sum()  # noqa: E731, B023
        best = min(loss(c) for c in [values[0] - 1, *(values + 0.125)])
        for near in (None, 0.05, -3.1):
            cut = tx.best_cut(values, pos, neg, near)
            assert abs(loss(cut) - best) < 1e-9
            if near is not None and loss(near) <= best + 1e-12:
                assert cut == near


def test_thresholds_follow_a_languages_rows_and_shrink_without_them():
    values = np.arange(-40, 41) / 10.0
    own = lambda cut, n: (values, n * (values >= cut).astype(float), n * (values < cut).astype(float))
    model = tx.Model(np.zeros((1, tx.DIM), np.float32), [], [], np.zeros(0), 0.0)
    tx.calibrate(model, {"big": own(0.0, 50), "many": own(2.0, 20), "few": (np.array([1.9]), np.array([0.0]), np.array([1.0]))})
    assert abs(model.shift) < 0.2 and model.thresholds["many"] > 0.8 and abs(model.thresholds["big"] - 0.5) < 0.05 and abs(model.thresholds["few"] - 0.5) < 0.05
    none = tx.Model(np.zeros((1, tx.DIM), np.float32), [], [], np.zeros(0), 0.0)
    tx.calibrate(none, {})
    assert none.shift == 0 and none.thresholds == {}


def test_calibration_counts_every_kept_row(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(d, t, l) for d, t, l, _ in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, y) for d, _, _, y in rows], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    usable = labels.where(tx.remainder(labels["doc_id"]) != 0)
    counts = tx._counts(docs, usable.where(tx._calibrates(labels["doc_id"])), model)
    kept = {r["doc_id"] for r in usable.where(tx._calibrates(labels["doc_id"])).collect()}
    for name in ("en", "de"):
        own = [r for r in rows if r[0] in kept and r[2] == name]
        assert counts[name][1].sum() == sum(y for *_, y in own) and counts[name][2].sum() == sum(1 - y for *_, y in own)
        logits = model.logits([t.encode() for _, t, _, _ in own])
        expected = {}
        for x in logits:
            expected[round(np.rint(x * tx.BINS) / tx.BINS, 9)] = expected.get(round(np.rint(x * tx.BINS) / tx.BINS, 9), 0) + 1
        assert {round(v, 9): p + n for v, p, n in zip(*counts[name], strict=True)} == expected


def test_very_long_text(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(d, t, l) for d, t, l, _ in rows], "doc_id long, text string, lang string")
    model = tx.train(docs, spark.createDataFrame([(d, y) for d, _, _, y in rows], "doc_id long, toxic int"))
    calm = "word after word " * 200_000
    long_ = spark.createDataFrame([(1, calm, "en"), (2, calm + "rotten", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["score"] for r in tx.score(long_, model).collect()}
    assert got[2] > got[1] and got[2] >= 0.5


def test_many_languages(spark):
    """Thresholds of a thousand languages are a map in the model, not a nested expression."""
    rows = corpus(300)
    docs = spark.createDataFrame([(d, t, f"l{d}") for d, t, _, _ in rows] + [(5000, "rotten", "l7"), (5001, "rotten", None), (5002, "rotten", "x")], "doc_id long, text string, lang string")
    model = tx.train(docs, spark.createDataFrame([(d, y) for d, _, _, y in rows], "doc_id long, toxic int"))
    model.thresholds.update({f"l{k}": 0.1 + k / 2000 for k in range(1000)} | {"": 0.25})
    got = {r["doc_id"]: r for r in tx.score(docs, model).collect()}
    assert [round(got[d]["threshold"], 6) for d in (5000, 5001, 5002)] == [0.1035, 0.25, 0.5]
    assert all(r["rejected"] == (r["score"] >= r["threshold"]) for r in got.values())
    kept = {r["doc_id"] for r in tx.accepted(docs, model).collect()}
    assert kept == {d for d, r in got.items() if not r["rejected"]}
