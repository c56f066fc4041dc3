import hashlib
import math
import random

import numpy as np
import pytest

from faultlens.llm import fingerprints as fp


def plain_entropy(window):
    counts = [window.count(b) for b in set(window)]
    s = sum(round(c * math.log2(c) * fp._ONE) for c in counts if c > 1)
    return (fp._FULL - s) * fp.SCALE // fp._FULL


def some_texts(n=40, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghiolmnrstuéß") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return ["", "a", "short text", "x" * 300, "ab" * 400] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 700))) for _ in range(n)]


def test_entropies_and_features_match_brute_force():
    texts = [t.encode() for t in some_texts(12)]
    flat = fp.Texts(texts)
    entropy, (text, at) = flat.entropies(), flat.own()
    ranks = fp.ranks_of(fp.entropy_counts(texts))
    chosen = list(zip(*(x.tolist() for x in fp._features(flat, ranks, fp.POPULAR)), strict=True))
    for k, t in enumerate(texts):
        padded = t + b"\0" * fp.WIDTH
        n = max(1, len(t) - fp.WIDTH + 1) if t else 0
        own = at[text == k]
        assert len(own) == n
        plain = [plain_entropy(padded[i : i + fp.WIDTH]) for i in range(n)]
        assert entropy[own].tolist() == plain
        score = [0] * n
        for s in range(-fp.RUN + 1, n) if n else ():
            inside = [i for i in range(max(0, s), min(n, s + fp.RUN))]
            score[min(inside, key=lambda i: (ranks[plain[i]], i))] += 1
        expected = [i for i in range(n) if score[i] >= fp.POPULAR]
        if n and not expected:
            expected = [min(range(n), key=lambda i: (ranks[plain[i]], i))]
        assert [a - int(flat.starts[k]) for x, a in chosen if x == k] == expected


def test_digest_does_not_depend_on_neighbours():
    texts = [t.encode() for t in some_texts()]
    ranks = fp.ranks_of(fp.entropy_counts(texts))
    together = [fp.written(d) for d in fp.digest(texts, ranks)]
    assert together == [fp.written(fp.digest([t], ranks)[0]) for t in texts]
    assert all(fp.written(fp.parsed(x)) == x for x in together)


def test_query_matches_brute_force(spark):
    texts = some_texts()
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)] + [(500, None), (501, texts[9]), (501, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = fp.fit_ranks(docs)
    assert (ranks == fp.ranks_of(fp.entropy_counts([(t or "").encode() for _, t in rows]))).all()
    got = sorted(tuple(r) for r in fp.compare_edited(docs, n_parts=6).collect())
    ordered = sorted((d, t or "") for d, t in rows)
    expected = []
    for (d, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = fp.digest([x.encode() for x in (t, e, u)], ranks)
        expected.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.written(a), fp.written(b), fp.likeness(a, b), fp.likeness(a, c)))
    assert got == sorted(expected)
    long_ = [r for r in got if r[1] > 600 and r[0] not in (500, 501)]
    assert np.mean([r[5] for r in long_]) > 0.35 and np.mean([r[6] for r in long_]) < 0.1
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in got)


def test_empty_table(spark):
    assert fp.compare_edited(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_id_and_clashing_columns(spark):
    rows = [(None, "first of all " * 9, 1, True), (2, None, 1, True), (1, "another text " * 9, 1, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, guest boolean")
    got = {r["doc_id"]: r for r in fp.compare_edited(docs, n_parts=3).collect()}
    texts = {None: rows[0][1], 1: rows[2][1], 2: ""}
    for own, following in ((None, 1), (1, 2), (2, None)):
        assert got[own]["edited_sha256"] == hashlib.sha256(fp.edited(texts[own], texts[following]).encode()).hexdigest()
    with pytest.raises(TypeError, match="numeric"):
        fp.compare_edited(docs.withColumn("doc_id", docs["text"]))
