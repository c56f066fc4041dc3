import hashlib

import public_tokenizers as P
import pytest
import tiktoken

from faultlens.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})

TEXTS = [
    None, "", " ", "a", "it's  two\n\n spaces \t ", "Élan vital, 123 4567 déjà-vu", "x" * 5000, "word " * 3000, "日本語" * 900 + " 終",
    "tail space ", "\n lead", "a b c  d", "<|endoftext|>", "\x1c\x1d odd", "é combining", "ab" * 40 + " " * 3000 + "z",
]


def expected(text):
    ids = ENC.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(16_384, 512), (64, 16)])
def test_same_as_library(spark, chunk, overlap):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(0, None, 7), (7, TEXTS[7], 7), (None, "no id", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode(docs, PATH, P.PATTERN, chunk, overlap, bpe.digests).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(r) for r in got], key=lambda r: (r[0] is None, r[0] or 0, r[1])) == sorted([(i, *expected(t)) for i, t, _ in rows], key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN, 64, 16), PATH, P.PATTERN).collect()
    assert {r["doc_id"]: bytes(r["content"]) for r in back} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, P.PATTERN).collect() == []


def test_cuts_beside_white_space(spark):
    """Runs of white space, contractions and digits at every offset around the cuts of small chunks."""
    runs = ["\n\n", "\t\n", " \n ", "   ", "\n\n\n", " \n", "'ll ", "12 ", " \n\nx", "\r\n\r\n"]
    texts = [("word " * 40)[:at] + "s" + run + "next words " * 12 for run in runs for at in range(60, 132)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r[0]: tuple(r)[1:] for r in bpe.encode(docs, PATH, P.PATTERN, 64, 16, bpe.digests).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}


def test_cuts_of_production_chunks(spark):
    runs = ["\n\n", "\t\n", " \n ", "    ", "'re "]
    texts = [("word " * 5000)[: 15_868 + at] + "s" + run + "next paragraph of words " * 400 for run in runs for at in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in bpe.encode(docs, PATH, P.PATTERN, finish=bpe.digests).collect()}
    assert got == {i: expected(t) for i, t in enumerate(texts)}


def test_columns_with_clashing_names_and_other_id_types(spark):
    docs = spark.createDataFrame([("a", "x y " * 50, 1, "k", 2), ("a", "x y " * 50, 1, "k", 2), (None, None, 1, "k", 2)], "doc_id string, text string, chunk int, text_key string, copies int")
    got = sorted(tuple(r) for r in bpe.encode(docs, PATH, P.PATTERN, 64, 16, bpe.digests).where("doc_id is not null").collect())
    assert got == [("a", *expected("x y " * 50))] * 2


def test_chunks_are_longer_than_overlaps(spark):
    with pytest.raises(ValueError, match="overlaps"):
        bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN, 64, 32)
