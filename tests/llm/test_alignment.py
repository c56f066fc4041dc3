import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from faultlens.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", "two  words\n\n here \t ", "Élan vital, 123 4567 déjà-vu", "x" * 700, "日本語 終 𓀀 🙂🙂 naïve", "a▁b", "▁", "\n", "\nlead", " lead",
    "<|endoftext|> plain <s> <unk> <0x41>", "it's we'll\r\n;\r\n}\r x", "a b 　c d", "\x1c odd\x1d \x1f x", "é ö", "tab\tone\n\ttwo", "end\r", "null\0in",
    "word " * 300, "hello world hello world", "a​b ᠎ c﻿ d", "under_score camelCase HTTPServer 3.14159 ,,, ...", "\r\r \r", "x \n y\n\n\nz",
]


def plain(texts):
    """Per text, from the libraries over the whole text: every A and B token's byte range, all pairs compared."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(x): x for x in letters} | {chr(0x100 + i): x for i, x in enumerate(x for x in range(256) if x not in letters)}
    rows, count = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        pieces = [b.id_to_piece(i) for i in ib]
        tb = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ib, pieces, strict=True)]
        if not b"".join(ta) == b"".join(tb) == (" " + text).encode():
            rows.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in ta]).tolist(), np.cumsum([len(t) for t in tb]).tolist()
        links, groups, i, j = [], [], 0, 0
        for x, end in enumerate(ends_a):
            for y, other in enumerate(ends_b):
                if max(end - len(ta[x]), other - len(tb[y])) < min(end, other):
                    links.append((ia[x], ib[y]))
        for end in sorted(set(ends_a) & set(ends_b)):
            i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, ia[i:i2])) + "|" + ",".join(map(str, ib[j:j2])))
            i, j = i2, j2
        count.update(links)
        rows.append((len(ia), len(ib), groups, links))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = r
            said = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((n_a, n_b, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), said))
    return out, count, best


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["the", "Straße", "naïve", "x", "123", "日本", "🙂", "<|endoftext|>", "</s>", "'ll", ".", ",", "-", "́", "Å", "\0", "_", "e"]
    gaps = [" ", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "", "", " ", " \n ", "\x1c", "​", "　", "\r", "   "]
    return ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("step", [alignment.STEP, 40])
def test_same_as_comparing_all_pairs_of_tokens(spark, step):
    texts = TEXTS + random_texts(250, 3)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 1), (4, texts[4], 1), (4, texts[4], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int").repartition(3)
    documents, pairs = alignment.align(docs, A, B, step)
    expected, count, best = plain([r[1] for r in rows])
    key = lambda r: (str(r[0]), r[1:])
    assert sorted((tuple(r) for r in documents.collect()), key=key) == sorted(((r[0], *e) for r, e in zip(rows, expected, strict=True)), key=key)
    assert {tuple(r) for r in pairs.collect()} == {(x, y, n, n == best[y]) for (x, y), n in count.items()}


def test_forgotten_units_are_aligned_again(monkeypatch):
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        sources = f.read(), g.read()
    texts = [random_texts(20, k) + TEXTS for k in range(12)]
    expected = [alignment.Aligner(*sources).block(t) for t in texts]
    for kept in (1, 25, 90):
        monkeypatch.setattr(alignment, "KEPT", kept)
        aligner = alignment.Aligner(*sources)
        for t, e in zip(texts, expected, strict=True):
            got = aligner.block(t)
            assert all(list(got[c]) == list(e[c]) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"))
    monkeypatch.undo()
    slow = alignment.Aligner(*sources)
    slow.ranks = None
    assert all(list(x) == list(y) for x, y in zip(slow.block(texts[0]).values(), expected[0].values(), strict=True))


def test_units_are_encoded_as_in_the_whole_text():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        aligner = alignment.Aligner(f.read(), g.read())
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    for text in random_texts(3000, 8):
        units = [u if u[0].isspace() else " " + u for u in aligner.units(text)]
        assert "".join(units) == " " + text
        assert aligner._a_ids(units)[0].tolist() == a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        if "▁" not in text:
            assert aligner._b_ids(units)[0].tolist() == b.encode(text), repr(text)


def test_union_find_gives_the_smallest_node():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (50, 20), (300, 280), (300, 900)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(u.tolist(), v.tolist(), strict=True):
                label[x] = label[y] = min(label[x], label[y])
        assert alignment.union_find(n, u, v).tolist() == label
    path = np.random.default_rng(3).permutation(5000)
    assert (alignment.union_find(5000, path[:-1], path[1:]) == 0).all()


def test_empty_table_and_other_id_types(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B)[0].collect() == []
    docs = spark.createDataFrame([("k", "a word"), (None, None)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_groups"] for r in alignment.align(docs, A, B)[0].collect()}
    assert got == {"k": 2, None: 0}
