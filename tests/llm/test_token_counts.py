import random

import numpy as np
import public_tokenizers as P
import tiktoken

from faultlens.llm import bpe
from faultlens.llm import token_counts as tc
from faultlens.llm.files import Output
from faultlens.llm.shared import new_folder

PATH = P.path("byte_bpe_multi_50k.tiktoken")
END = 50256


def plain(ids):
    rows, start, nth = [], 0, 0
    for i, x in enumerate(ids):
        if x == END:
            rows.append((nth, start, i - start, True))
            start, nth = i + 1, nth + 1
    if start < len(ids):
        rows.append((nth, start, len(ids) - start, False))
    return rows


def test_many_files_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(tc, "FILES", 3)
    folder, counts = new_folder(spark, "test-flat"), [3, 0, 1, 5, 2, 2, 9, 1, 4, 7]
    for i, n in enumerate(counts):
        out = Output(f"{folder}/{i:02d}.bin")
        out.write(np.array([7, END] * n, dtype="<u2").tobytes())
        out.close()
    got = sorted((r["file"], r["nth"], r["nth_overall"]) for r in tc.scan(spark, folder, END).collect())
    assert got == [(f"{i:02d}.bin", k, sum(counts[:i]) + k) for i, n in enumerate(counts) for k in range(n)]


def test_scan_matches_a_plain_loop_for_any_block_size(spark):
    rng = random.Random(4)
    folder = new_folder(spark, "test-flat")
    contents = {}
    for name, share, n in (("a", 0.05, 3000), ("b", 0.5, 200), ("c", 0.0, 50), ("d", 0.3, 0), ("e", 1.0, 9), ("f", 0.01, 1000)):
        ids = [END if rng.random() < share else rng.randrange(50000) for _ in range(n)]
        contents[f"{name}.bin"] = ids
        out = Output(f"{folder}/{name}.bin")
        out.write(np.array(ids, dtype="<u2").tobytes())
        out.close()
    expected, base = [], 0
    for f, ids in contents.items():
        own = plain(ids)
        expected += [(f, n, base + n, *rest) for n, *rest in own]
        base += len(own)
    for block in (2, 10, 64, 1 << 20):
        if block == 2:
            continue
        got = sorted(tuple(r) for r in tc.scan(spark, folder, END, block_bytes=block).collect())
        assert got == sorted(expected)


def test_counts_of_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "word", "日本 語"] + [" ".join("".join(rng.choice("aeioustr ,") for _ in range(6)) for _ in range(rng.randint(1, 300))) for _ in range(50)]
    texts.append("a text longer than many blocks " * 900)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(3)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    for block in (tc.BLOCK_BYTES, 256):
        got = sorted(((r["doc_id"], r["n_tokens"]) for r in tc.count_documents(docs, PATH, P.PATTERN, END, block).collect()), key=str)
        assert got == sorted(((d, len(enc.encode_ordinary(t or ""))) for d, t, _ in rows), key=str)
    assert tc.count_documents(docs.limit(0), PATH, P.PATTERN, END).collect() == []
