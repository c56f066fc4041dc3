"""The pipeline, stage by stage, against plain versions over what the stage before kept."""

import hashlib
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402

from faultlens.llm import bpe, mixing, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or name == "bpe"
        kept.append(docs.collect())
    start, clean, single, apart, mix, ids = kept
    model = toxicity.train(spark.createDataFrame(start), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = model.scores([(r["text"] or "").encode() for r in start])
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r, s in zip(start, scores, strict=True) if s < model.thresholds.get(r["lang"], 0.5)}

    best = {}
    for r in clean:
        key = re.sub(SPACE, "", r["text"] or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    assert {r["doc_id"] for r in single} == {d for _, d in best.values()}

    sets = {}
    for r in single:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in apart} == {d for d in sets if find(d) == d}

    size = {r["doc_id"]: len(re.findall(mixing.WORD, r["text"] or "")) for r in apart}
    total, taken, longest = {}, {}, {}
    for r in apart:
        total[r["source"]] = total.get(r["source"], 0) + size[r["doc_id"]]
        longest[r["source"]] = max(longest.get(r["source"], 0), size[r["doc_id"]])
    for r in mix:
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
    for s, target in mixing.targets(total).items():
        assert abs(taken.get(s, 0) - target) <= longest[s] / 2 + 1

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    expected = []
    for r in mix:
        tokens = enc.encode_ordinary(r["text"] or "")
        expected.append((r["doc_id"], len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in ids) == sorted(expected)


def staged(spark, docs, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    return docs


def test_nulls_repeated_rows_and_further_columns(spark, tmp_path):
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()
    odd = [(9000, None, None, None, None), (9001, "", "en", "web", 0), (9002, " \n", "en", None, 2), (None, "a text without an id", "fr", "web", 20), (9003, "long words " * 30_000, "en", "web", 330_000)]
    rows = [(*r, 1, "x") for r in [*map(tuple, some), *odd, tuple(some[0]), tuple(some[0])]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk int, _size string")
    got = staged(spark, docs, tmp_path).collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {r[0]: r[1] for r in rows}
    assert got and all(r["n_tokens"] == len(enc.encode_ordinary(texts[r["doc_id"]] or "")) for r in got)
    mixed = spark.read.parquet(str(tmp_path / "mixing"))
    assert mixed.columns == docs.columns and {(r["chunk"], r["_size"]) for r in mixed.collect()} == {(1, "x")}


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert staged(spark, docs, tmp_path).collect() == []
