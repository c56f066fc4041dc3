"""Alignment of two tokenizers over whole texts, and corpus-wide counts of the token pairs that meet.

A byte-level BPE (A) encodes a space and the text, a sentence-piece model with byte fallback (B) the text, before which
it sets a space itself. Both cut the same bytes, so an A and a B token either overlap or not: these overlaps are the
edges of a bipartite graph. Its connected components, found by union-find, are the smallest groups of tokens that
begin and end together; the members of a component are expanded into its links.

1. Both tokenizers surely cut before white space that follows another character (checked against B's pieces when the
   model is read), so a text is taken apart there, and each different unit is encoded and aligned once a block (a few
   MB of texts; up to KEPT units are kept between blocks). A model without that property gets whole texts as units.
2. A block is stored as: its different pairs with their numbers, its units as lists of pairs, its documents as
   lists of units. So what is moved is a row for each different pair of a block, not for each link.
3. Pairs are summed over the corpus; B ids get their highest count (as many rows as B has ids, broadcast). The counts
   go back to the blocks by a join on the pair, in which a pair has one row a block, and add up over units and
   documents; a task takes one block at a time.

Results: null and empty texts, and texts whose tokens do not give back a space and the text (U+2581 in a text is one
such case), have no tokens: zeros and '' for groups_sha256; they count nothing. Strings of special tokens are plain
text. Repeated rows and null doc_ids have a row each, and count each. An empty table gives an empty result. Columns
besides doc_id and text are not read, whatever their names. A block holds STEP bytes or one text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.shared import WIDE_ROWS, by_bytes, delete, stored, trimmed

STEP = 4 << 20
KEPT = 200_000
SPACE = "▁"
_SUMS = ("n_a", "n_b", "n_groups", "n_links")

# All that either tokenizer, or this language, takes for white space (fixed values)
_WIDE = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# how byte-level vocabularies of the usual kind split texts (fixed value)
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and edges (u, v): each node's root, the smallest node of its component. All edges unite
    their sets at once, the larger root below the smaller; then all paths are compressed; edges that join two sets are
    looked at again."""
    parent = np.arange(n)
    while len(u):
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        u, v = ru[apart], rv[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
    return parent


class _Numbers(dict):
    """unit -> its number, in the order of first use."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class _Units:
    """What both tokenizers make of numbered units: sizes (ok, tokens, groups, links), links (a pair is A id << 32 |
    B id) and written groups."""

    def __init__(self) -> None:
        self.sizes = {f: np.zeros(0, np.int64) for f in ("ok", *_SUMS)}
        self.pairs, self.said = np.zeros(0, np.int64), []

    def extend(self, sizes: dict[str, np.ndarray], pairs: np.ndarray, said: list[str]) -> None:
        self.sizes = {f: np.concatenate((x, sizes[f])) for f, x in self.sizes.items()}
        self.pairs = np.concatenate((self.pairs, pairs))
        self.said += said

    def cut(self, n: int) -> None:
        self.pairs = self.pairs[: int(self.sizes["n_links"][:n].sum())]
        self.sizes = {f: x[:n] for f, x in self.sizes.items()}
        del self.said[n:]


class Aligner:
    def __init__(self, definition: str, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(letters)]
        byte = {chr(b): b for b in letters} | {chr(0x100 + i): b for i, b in enumerate(rest)}
        a_bytes = [bytes(byte.get(c, 0x3F) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_words, self.b_words = _Words(a_bytes), _Words(b_bytes)
        self.b_space = self.b.piece_to_id(SPACE)
        self.ranks = _as_ranks(json.loads(definition), a_bytes)
        # where B surely cuts: before a space (unless pieces go on over one) and before characters that stand alone
        alone = "".join(c for c in "\n\t" if not any(c in p for p in pieces if len(p) > 1))
        self.whole = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.unit = re.compile(f"[{_WIDE}]*[^{_WIDE}]+(?:(?![ {alone}])[{_WIDE}]+[^{_WIDE}]*)*|[{_WIDE}]+")
        self.lines = "\n" in alone
        self.said = [[f"{i}{mark}" for i in range(max(len(a_bytes), len(b_bytes)))] for mark in ",|;"]
        self._forget()

    def _forget(self) -> None:
        self.number, self.known, self.missed, self.held = _Numbers(), _Units(), 0, 0

    def units(self, text: str) -> list[str]:
        """A space and the text, in parts; each begins with white space, or with a space that is left out."""
        if self.whole:
            return [" " + text]
        if self.lines and " ".join(text.split()) == text.replace("\n", " "):  # single spaces or line ends between words
            return text.replace("\n", " \n").split(" ")
        return self.unit.findall(" " + text)

    def _a_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, tokens of each unit)."""
        if self.ranks is None or self.whole:
            return _flat([e.ids for e in self.a.encode_batch(units, add_special_tokens=False)])
        # put together they are cut at each unit's white space, unless the unit before ends in some
        apart = [k for k, u in enumerate(units) if u[-1].isspace()]
        alone = set(apart)
        rest = [u for k, u in enumerate(units) if k not in alone] if apart else units
        ids = np.frombuffer(self.ranks.encode_to_numpy("".join(rest)).tobytes(), dtype=np.uint32).astype(np.int64)
        ends = np.cumsum([len(u.encode()) for u in rest])
        n = np.diff(np.searchsorted(np.cumsum(self.a_words.length[ids]), ends, side="right"), prepend=0)
        if not apart:
            return ids, n
        other, n_other = _flat([self.ranks.encode_ordinary(units[k]) for k in apart])
        place = np.concatenate((np.array([k for k in range(len(units)) if k not in alone], dtype=np.int64), apart))
        both, n_both = np.concatenate((ids, other)), np.concatenate((n, n_other))
        back = np.argsort(place)
        start = (np.cumsum(n_both) - n_both)[back]
        n = n_both[back]
        return both[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(both))], n

    def _b_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B sets a space before what it encodes (but not before nothing): units that begin with another character get
        it taken off again."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return _flat([(ids or [self.b_space]) if u[0] == " " else (ids[1:] if ids[:1] == [self.b_space] else [0]) for u, ids in zip(units, found, strict=True)])

    def _groups_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For two ways to cut the same bytes: the group of each A and B token, and the A and B token of each link."""
        a_start, b_start = self.a_words.starts(a), self.b_words.starts(b)
        # between two neighbouring cuts of either lies one overlap of one A and one B token: an edge
        cuts = np.union1d(a_start, b_start)
        of_a, of_b = np.searchsorted(a_start, cuts, side="right") - 1, np.searchsorted(b_start, cuts, side="right") - 1
        root = union_find(len(a) + len(b), of_a, of_b + len(a))
        is_root = np.zeros(len(a) + len(b), dtype=np.int64)
        is_root[root] = 1
        group = (np.cumsum(is_root) - 1)[root]  # roots are A tokens, so groups are in the order of the text
        return group[: len(a)], group[len(a) :], of_a, of_b

    def _written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(the ids of all groups in order, each with the mark that follows it; places of A and of B tokens)."""
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        out = np.empty(len(a) + len(b), dtype=object)
        for ids, group, at, last in ((a, group_a, at_a, 1), (b, group_b, at_b, 2)):
            mark = np.zeros(len(ids), dtype=np.int64)
            mark[np.flatnonzero(np.diff(group, append=-1))] = last
            table = self.said
            out[at] = [table[m][i] for m, i in zip(mark.tolist(), ids.tolist(), strict=True)]
        return out.tolist(), at_a, at_b

    def align(self, units: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray, list[str]]:
        """(sizes of the units, links one unit after the other, written groups)."""
        (a, n_a), (b, n_b) = self._a_ids(units), self._b_ids(units)
        raw = [u.encode() for u in units]
        length = np.array([len(r) for r in raw], dtype=np.int64)
        ok = (self.a_words.sums(a, n_a) == length) & (self.b_words.sums(b, n_b) == length)
        keep_a, keep_b = np.repeat(ok, n_a), np.repeat(ok, n_b)
        a, b, n_a, n_b = a[keep_a], b[keep_b], n_a * ok, n_b * ok
        flat = np.frombuffer(b"".join([r for r, good in zip(raw, ok.tolist(), strict=True) if good]), dtype=np.uint8)
        wrong = (self.a_words.text(a) != flat) | (self.b_words.text(b) != flat)
        if wrong.any():
            bad = _sums(wrong.astype(np.int64), length * ok) > 0
            a, b = a[np.repeat(~bad, n_a)], b[np.repeat(~bad, n_b)]
            ok, n_a, n_b = ok & ~bad, n_a * ~bad, n_b * ~bad
        group_a, group_b, of_a, of_b = self._groups_of(a, b)
        unit_of_a = np.repeat(np.arange(len(units)), n_a)
        n_groups = np.bincount(unit_of_a[np.flatnonzero(np.diff(group_a, prepend=-1))], minlength=len(units))
        n_links = np.bincount(unit_of_a[of_a], minlength=len(units))
        parts, _, _ = self._written(a, b, group_a, group_b)
        ends = np.cumsum(n_a + n_b).tolist()
        said = ["".join(parts[x:y]) for x, y in zip([0, *ends], ends, strict=False)]
        sizes = {"ok": ok.astype(np.int64), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links}
        return sizes, a[of_a] << 32 | b[of_b], said

    def block(self, texts: list[str | None]) -> dict[str, list]:
        """The columns of a block but for its doc_ids."""
        number, before = self.number, len(self.number)
        order = [np.fromiter(map(number.__getitem__, self.units(t) if t else ()), dtype=np.int64) for t in texts]
        if len(number) > before:
            new = [u if u[0].isspace() else " " + u for u in islice(number, before, None)]
            self.known.extend(*self.align(new))
            self.missed, self.held = self.missed + len(new), self.held + sum(map(len, new))
        sizes, said = self.known.sizes, self.known.said
        first = np.concatenate(([0], np.cumsum(sizes["n_links"])))
        order = [o if len(o) and sizes["ok"][o].all() else o[:0] for o in order]
        lengths = np.array([len(o) for o in order], dtype=np.int64)
        flat = np.concatenate(order)
        sums = [_sums(sizes[f][flat], lengths) for f in _SUMS]
        digest = [hashlib.sha256("".join([said[i] for i in o.tolist()])[:-1].encode()).hexdigest() if len(o) else "" for o in order]
        own, times = np.unique(flat + (np.repeat(np.arange(len(order)), lengths) << 32), return_counts=True)
        unit, doc_first = own & 0xFFFFFFFF, np.searchsorted(own >> 32, np.arange(len(order) + 1))
        used, unit = np.unique(unit, return_inverse=True)
        unit_times = np.bincount(unit, weights=times, minlength=len(used)).astype(np.int64)
        n = sizes["n_links"][used]
        unit_first = np.concatenate(([0], np.cumsum(n)))
        links = self.known.pairs[np.repeat(first[used] - unit_first[:-1], n) + np.arange(unit_first[-1])]
        pairs, unit_pair = np.unique(links, return_inverse=True)
        pair_times = np.bincount(unit_pair, weights=np.repeat(unit_times, n), minlength=len(pairs)).astype(np.int64)
        if self.missed > 8 * KEPT or self.held > 32 * KEPT:
            self._forget()
        elif len(number) > KEPT:
            while len(number) > KEPT:
                number.popitem()
            self.known.cut(KEPT)
        return dict(zip(_BLOCK, (*sums, digest, doc_first, unit, times, unit_first, unit_pair, pairs, pair_times), strict=True))


class _Words:
    """The bytes of a vocabulary's ids."""

    def __init__(self, words: list[bytes]) -> None:
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(words), dtype=np.uint8)

    def starts(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return np.cumsum(n) - n

    def sums(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return _sums(self.length[ids], lengths)

    def text(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.flat[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of neighbouring stretches of so many values."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(lengths)))])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in lists], dtype=np.int64)
    return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(lengths.sum())), lengths


def _as_ranks(definition: dict, words: list[bytes]):
    """The same vocabulary for a quicker library, if it is one that merges by ascending id and splits by the usual
    pattern; otherwise None."""
    import tiktoken

    model, before = definition["model"], definition["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or definition["normalizer"] or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    ranks = {words[i]: i for i in vocab.values()}
    if any(b <= a for a, b in zip(merged, merged[1:], strict=False)) or len(merged) + 256 != len(ranks) or len(ranks) != len(vocab):
        return None
    return tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


_KINDS = {
    **dict.fromkeys(_SUMS, "long"), "groups_sha256": "string", "doc_first": "int", "doc_unit": "int", "doc_times": "int",
    "unit_first": "int", "unit_pair": "int", "pairs": "long", "times": "long",
}
_BLOCK = tuple(_KINDS)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

_aligners: dict[int, Aligner] = {}


def _aligner(source) -> Aligner:
    key = hash(source.value)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(*source.value)
    return _aligners[key]


def _blocks(docs: DataFrame, definition: str, model: bytes, step: int) -> DataFrame:
    source = docs.sparkSession.sparkContext.broadcast((definition, model))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task, nth = _aligner(source), TaskContext.get().partitionId(), 0

        def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            columns = aligner.block(table.column("text").to_pylist())
            ids = table.column("doc_id").combine_chunks()
            lists = [pa.array([columns[c]], pa.list_(_ARROW[k])) for c, k in _KINDS.items()]
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | nth], pa.int64()), ids, *lists], ["block", "doc_id", *_KINDS])

        held, size = [], 0  # Arrow batches may be small: a block goes over several
        for some in by_bytes(batches, "text", step):
            here = some.column("text").nbytes
            if held and size + here > step:
                yield made(held)
                held, size, nth = [], 0, nth + 1
            held.append(some)
            size += here
        if held:
            yield made(held)

    schema = f"block long, doc_id array<{id_type}>, " + ", ".join(f"{c} array<{k}>" for c, k in _KINDS.items())
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _finish(block: pa.Table, counts: pa.Table) -> pa.Table:
    """A block and a row for each of its pairs -> a row for each document."""
    of = {c: block.column(c)[0].values for c in ("doc_id", *_SUMS, "groups_sha256")}
    doc_first, unit, times, unit_first, pair = (block.column(c)[0].values.to_numpy() for c in ("doc_first", "doc_unit", "doc_times", "unit_first", "unit_pair"))
    pos, sums = counts.column("pos").to_numpy(), []
    for what in ("best", "n"):
        value = np.zeros(len(pos), np.int64)
        value[pos] = counts.column(what).to_numpy()
        per_unit = np.diff(np.concatenate(([0], np.cumsum(value[pair])))[unit_first])
        sums.append(np.diff(np.concatenate(([0], np.cumsum(per_unit[unit] * times)))[doc_first]))
    return pa.table([*of.values(), pa.array(sums[0]), pa.array(sums[1])], [*of, "n_best", "count_sum"])


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): documents has doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; pairs
    has a_id, b_id, n (links of the corpus), best (n is the highest of this b_id). byte_vocabulary is a file of the
    tokenizers library, piece_model one of sentencepiece; both are read by the driver and broadcast (some MB)."""
    with open(byte_vocabulary, encoding="utf-8") as f:
        definition = f.read()
    with open(piece_model, "rb") as f:
        model = f.read()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    blocks, _ = stored(_blocks(docs, definition, model, step), "align-blocks", WIDE_ROWS)
    summed = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    summed, summed_place = stored(summed, "align-sums")
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = summed.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))  # at most one row an id of B
    counted = summed.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id").select("pair", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))
    counted, _ = stored(counted, "align-pairs")
    delete(docs.sparkSession, summed_place)
    # sorted by block on both sides, so a task holds one block and its counts at a time
    back = blocks.select("block", F.posexplode("pairs").alias("pos", "pair")).join(counted.select("pair", "n", "best"), "pair").select("block", "pos", "n", "best")
    rest = blocks.drop("pairs", "times").withColumnRenamed("block", "own").groupBy("own").cogroup(back.groupBy("block"))
    result = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    documents = rest.applyInArrow(_finish, result).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    pairs = counted.select(F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("b_id").cast("int").alias("b_id"), "n", "best")
    return documents, pairs
