import hashlib
import random
import zlib

import numpy as np
import pytest

from faultlens.llm import periodic, queries


def plain(words, least=6, times=4):
    """All runs by looking at every start and period, smallest periods first."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - i + q >= max(least, times * q) and not any(q % p == 0 for p in out.get((i, e + q), [])):
                out.setdefault((i, e + q), []).append(q)
            i = e
    return sorted(((s, e - s, q) for (s, e), periods in out.items() for q in periods), key=lambda r: (r[0], r[2]))


def random_words(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(60))]
    if kind == 1:
        return [rng.choice("abcdefgh") for _ in range(rng.randrange(90))]
    words = [str(rng.randrange(40)) for _ in range(rng.randrange(50))]
    for _ in range(rng.randrange(1, 4)):
        p = [rng.choice("abc") for _ in range(rng.randrange(1, 12))]
        words += (p * rng.randrange(2, 9))[: -rng.randrange(1, 4)] + [str(rng.randrange(9))] * rng.randrange(3)
    return words


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (5, 3), (12, 6), (9, 2)])
def test_same_as_looking_everywhere(least, times):
    rng = random.Random(11)
    for _ in range(40):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 25))] + [[]]
        texts += [list(texts[0])] * 3
        found = periodic.find(texts, least, times)
        assert [found.get(k, []) for k in range(len(texts))] == [plain(t, least, times) for t in texts]


def test_a_run_stays_within_its_candidates():
    rng = random.Random(4)
    for least, times in ((6, 4), (2, 2), (7, 3)):
        for _ in range(100):
            words = random_words(rng)
            numbers = np.array([hash(w) % 1000 for w in words], dtype=np.int64)
            at, stretch = periodic.candidates(numbers, np.zeros(len(words), dtype=np.int64), least, times)
            of = dict(zip(at.tolist(), stretch.tolist(), strict=True))
            for s, n, _ in plain(numbers.tolist(), least, times):
                assert len({of.get(i, -i - 1) for i in range(s, s + n)}) == 1


def test_vocabulary_of_squares_is_complete():
    """Every square of a random sequence is below some covering one, and blocks are as defined."""
    rng = random.Random(6)
    for _ in range(60):
        body = [rng.randrange(3) for _ in range(rng.randrange(2, 60))]
        s = periodic.Sequence(np.array([90, *body, 91]))
        text = [90, *body, 91]
        first = s.blocks().tolist()
        for a, b in zip(first, first[1:], strict=False):
            most = max((n for j in range(a) for n in range(len(text) - a + 1) if text[j : j + n] == text[a : a + n]), default=0)
            assert b - a == max(1, most)
        start, length, period = s.runs(len(text))
        got = {(i, q) for a, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True) for i in range(a, a + n - 2 * q + 1)}
        squares = {(i, q) for q in range(1, 31) for i in range(len(text) - 2 * q + 1) if text[i : i + q] == text[i + q : i + 2 * q]}
        primitive = {(i, q) for i, q in squares if not any(q % p == 0 and text[i : i + q] == text[i : i + p] * (q // p) for p in range(1, q))}
        assert got == primitive


def test_long_periods_and_long_texts():
    rng = random.Random(9)
    root = [str(rng.randrange(500)) for _ in range(2500)]
    words = ["x", "y"] + (root * 5)[:12_345] + ["end"] + ["z"] * 40_000
    assert periodic.find([words])[0] == [(2, 12_345, 2500), (12_348, 40_000, 1)]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_on_whole_small_tables(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "ha " * 9, "a\xa0b " * 6, "\x1ca " * 6]
    texts += [" ".join(random_words(rng)) for _ in range(200)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(4, "ha " * 9, 1), (None, "ho " * 8, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, period int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text, _ in rows:
        words = periodic.WORD.findall(text or "")
        words = words if doc_id is None else planted(doc_id, words)
        runs = plain(words)
        best = None
        for s, n, q in runs:
            if best is None or n * best[2] > best[1] * q:
                best = (s, n, q)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        row = (*(best or (None, None, None)), best and best[1] * 1000 // best[2])
        want.append((doc_id, len(runs), *row, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)


def test_spans_and_empty_table(spark):
    docs = spark.createDataFrame([("k", "go a b a b a b a b stop")], "doc_id string, text string")
    r = periodic.detect(docs).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 8, 2)] and r["collapsed"] == "go a b stop"
    assert periodic.detect(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="two periods"):
        periodic.find([["a"]], times=1)
