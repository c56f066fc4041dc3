import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultlens.llm import pfor

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=3000), st.integers(0, 32), st.sampled_from([50.0, 90.0, 100.0]))
def test_blocks_round_trip(values, bits, percentile):
    ids = np.array(values, dtype=np.uint64) & np.uint64((1 << bits) - 1) | (np.array(values, dtype=np.uint64) * np.uint64(len(values) % 7 == 0) & np.uint64(2**32 - 1))
    ids = ids.astype(np.uint32)
    blocks = pfor.encode_blocks(ids, percentile)
    if blocks:
        starts = np.cumsum([0, *map(len, blocks[:-1])])
        assert (pfor.decode_blocks(b"".join(blocks), starts)[: len(ids)] == ids).all()


def texts():
    rng = random.Random(5)
    own = [f"{a}{token}{b}" for token in ("<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|") for a in ("", "a", "word ", "É") for b in ("", "b", " word", "\n")]
    own += [None, "", " ", "It's WE'LL don't 12.5% ''' ok", "Éclair ß ÿ × ÷ ²½", "日本 語　x\xa0y", "é Ñ", "<|endoftext|> Σας ΟΔΟΣ", "x" * 3000, "\x1c a\x1fb \x85c", "İstanbul ǅ ŉ"]
    return own + [" ".join("".join(rng.choice("aeltrnsdÉéß'1.,") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 900))) for _ in range(60)]


def test_same_as_library_and_order(spark):
    rows = [(10 * i - 50, t, "x") for i, t in enumerate(texts())] + [(0, "twice", "x"), (0, "twice", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    folder = pfor.write(docs, PATH, end_id=2, n_files=5)
    got = [tuple(r) for r in pfor.read_checksums(spark, folder).collect()]
    t = Tokenizer.from_file(PATH)
    expected, start = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected
    ids = {r["start"]: np.frombuffer(r["ids"], "<u4") for r in pfor.read(spark, folder).collect()}
    assert all(len(ids[s]) == n and zlib.crc32(ids[s].tobytes()) == c for _, s, n, c in expected)


def test_doc_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError, match="integer"):
        pfor.write(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pfor.read(spark, pfor.write(docs, PATH)).collect() == []
