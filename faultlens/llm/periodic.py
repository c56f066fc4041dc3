"""Runs of repeated words in whole texts: where they are, and the texts with each run cut to its first period.

A run is a longest stretch with smallest period q (words q apart are identical) of at least max(least, times * q) words.
Runs are found as in Gusfield and Stoye's linear method for tandem repeats (squares), over a step of texts at once:

1. In a run every window of some words stands a second time, one period away. Words outside such windows are left out,
   stretch by stretch, until nothing changes; this is exact (hashes only keep more) and leaves little of most texts.
2. The stretches, with separators that occur once, become one sequence. Naming all substrings of 2^k words by doubling
   gives longest common extensions in either direction, and the suffix tree in the form of its leaves in order with the
   lengths of their common prefixes: an inner node is an interval of leaves and a depth.
3. The sequence is cut into Lempel-Ziv blocks. The squares that touch a block's borders, tested by two extensions for
   each period, cover the leftmost occurrence of every kind of square, up to rotations to the right.
4. From the locus of each primitive one, suffix links are walked as long as the next word repeats, all walks at once;
   loci that are met twice count once. The result is the vocabulary of primitive squares.
5. The leaves below a locus are the occurrences of its square. Occurrences with one period that begin at neighbouring
   words merge into a run; its period is its smallest, as its squares are primitive.

Periods above the longest stretch / times are not looked for, as no run can have them.

Results: null, empty and blank texts have no words and no runs. Repeated rows have a row each; null doc_ids are carried
through. An empty table gives an empty result. Columns besides doc_id and text are not read, whatever their names.
Texts are taken in steps of STEP bytes; a longer one is worked on whole, with about 8 * log2(longest repeat) bytes for
each of its words that repeat as in 1.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultlens.llm.shared import by_bytes, trimmed
from faultlens.llm.wordhash import mix64

STEP = 1 << 20
LEAST, TIMES = 6, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]  # start, length, period


# --- words that may be in a run


def window_width(least: int, times: int) -> int:
    """The widest window of which every occurrence in any run has another one a period away inside the run."""
    return 1 + min(max(least - 2 * q, (times - 2) * q) for q in range(1, least // 2 + 2))


def candidates(words: np.ndarray, text: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, stretch): ascending positions of words that may be in a run, and which stretch of neighbouring
    words of one text they are in."""
    width = window_width(least, times)
    value, stretch, at = mix64(words.astype(np.uint64) + np.uint64(1)), text, np.arange(len(words))
    while len(at) >= width:
        n = len(at) - width + 1
        key = np.zeros(n, dtype=np.uint64)
        for j in range(width):
            key = key * np.uint64(0x9E3779B97F4A7C15) + value[j : n + j]
        inside = np.flatnonzero(stretch[:n] == stretch[width - 1 :])
        key = mix64(key[inside]) + mix64(stretch[inside].astype(np.uint64))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = inside[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(order) else inside
        edge = np.bincount(twice, minlength=len(at) + 1)[: len(at) + 1] - np.bincount(twice + width, minlength=len(at) + 1)[: len(at) + 1]
        keep = np.cumsum(edge[:-1]) > 0
        old, at = stretch[keep], at[keep]
        new = np.cumsum(np.concatenate(([1], (np.diff(at) != 1) | (np.diff(old) != 0)))) - 1 if len(at) else at
        long = np.bincount(new)[new] >= least if len(at) else keep[:0]
        value, stretch, at = value[keep][long], new[long], at[long]
        if keep.all() and long.all():
            return at, stretch
    return at[:0], stretch[:0]


# --- squares of one sequence


class Sequence:
    """A sequence whose first and last element occur once, with names of its substrings of 2^k elements (equal
    substrings, equal names, ordered like them) up to the longest repeat."""

    def __init__(self, s: np.ndarray) -> None:
        self.n = n = len(s)
        self.names = [np.unique(s, return_inverse=True)[1].astype(np.int64)]
        while True:
            low, k = self.names[-1], 1 << (len(self.names) - 1)
            if k >= n or low.max() == n - 1:
                break
            after = np.full(n, -1, dtype=np.int64)
            after[: n - k] = low[k:]
            self.names.append(np.unique(low * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
        self.rank = self.names[-1]
        self.leaves = np.empty(n, dtype=np.int64)
        self.leaves[self.rank] = np.arange(n)
        self.common = np.zeros(n, dtype=np.int64)  # of each leaf with the one before
        self.common[1:] = self.forward(self.leaves[:-1], self.leaves[1:])
        self.lowest = [self.common]  # minima of 2^k neighbours
        while (1 << len(self.lowest)) <= n:
            last, k = self.lowest[-1], 1 << (len(self.lowest) - 1)
            self.lowest.append(np.minimum(last[:-k], last[k:]))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common substrings that start at i and j (i differs from j)."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            same = self.names[k][i + out] == self.names[k][j + out]
            out[same] += 1 << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common substrings that end at i and j."""
        out = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            same = (a >= 0) & (b >= 0)
            same[same] = self.names[k][a[same]] == self.names[k][b[same]]
            out[same] += 1 << k
        return out

    def locus(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf of the node below which all occurrences of the `depth` elements at i are."""
        low, high = self.rank[i].copy(), self.rank[i].copy()
        for k in range(len(self.lowest) - 1, -1, -1):
            step = 1 << k
            at = low - step + 1
            down = at >= 1
            down[down] = self.lowest[k][at[down]] >= depth[down]
            low[down] -= step
            up = high + step < self.n
            up[up] = self.lowest[k][high[up] + 1] >= depth[up]
            high[up] += step
        return low, high

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks: each is the longest prefix of the rest that starts somewhere before, or one
        element. The nearest leaves with an earlier start, on both sides, hold the longest."""
        leaves, n = self.leaves.tolist(), self.n
        before, after, stack = [-1] * n, [-1] * n, []
        for at in leaves:
            while stack and stack[-1] > at:
                after[stack.pop()] = at
            before[at] = stack[-1] if stack else -1
            stack.append(at)
        longest = np.ones(n, dtype=np.int64)
        for side in (np.array(before), np.array(after)):
            some = np.flatnonzero(side >= 0)
            longest[some] = np.maximum(longest[some], self.forward(some, side[some]))
        starts, at, jump = [], 0, longest.tolist()
        while at < n:
            starts.append(at)
            at += jump[at]
        return np.array([*starts, n], dtype=np.int64)

    def covering(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, period) of squares with periods up to `most`, so that the leftmost occurrence of every kind of square
        is one of them or lies to the right of one in an unbroken row of squares of its period."""
        first = self.blocks()
        h, h1, h2 = first[:-2], first[1:-1], first[2:]
        found = []
        # the second half begins in this block, the square ends beyond it
        k, which = _ranges(np.minimum(h1 - h, most))
        at, q = h1[which], h1[which] - k
        right, left = self.forward(at, q), self.backward(at - 1, q - 1)
        ok = (right + left >= k) & (right > 0)
        found.append((np.maximum(q - left, q - k + 1)[ok], k[ok]))
        # the square begins before this block, its second half begins in it
        k, which = _ranges(np.minimum(h2 - h, most))
        at, q = h[which], h[which] + k
        inside = (q < self.n) & (at > 0)
        k, which, at, q = k[inside], which[inside], at[inside], q[inside]
        right, left = self.forward(at, q), self.backward(at - 1, q - 1)
        start = np.maximum(at - left, at - k + 1)
        ok = (right + left >= k) & (right > 0) & (left > 0) & (start + k <= h1[which])
        found.append((start[ok], k[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def primitive(self, start: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Which squares' halves are not powers: no prime part of the period is a period of the square."""
        ok, rest = np.ones(len(start), dtype=bool), period.copy()
        prime = _smallest_primes(int(period.max(initial=1)))
        while (rest > 1).any():
            p = prime[rest]
            some = np.flatnonzero(rest > 1)
            part = period[some] // p[some]
            ok[some] &= self.forward(start[some], start[some] + part) < 2 * period[some] - part
            while True:
                divides = (rest > 1) & (rest % np.maximum(p, 1) == 0) & (p > 1)
                if not divides.any():
                    break
                rest[divides] //= p[divides]
        return ok

    def runs(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of all runs that hold a square of a period up to `most`."""
        start, period = self.covering(most)
        keep = self.primitive(start, period)
        start, period = np.unique(np.stack((start[keep], period[keep])), axis=1)
        # suffix links: from a square to the one that begins a word later, while there is one and it is another
        walk = np.minimum(self.forward(start, start + period) - period, period - 1) + 1
        step, which = _ranges(walk)
        at, k = start[which] + step - 1, period[which]
        low, high = self.locus(at, 2 * k)
        kinds = np.unique(np.stack((k, low, high)), axis=1)  # the vocabulary
        nth, which = _ranges(kinds[2] - kinds[1] + 1)
        at, k = self.leaves[kinds[1][which] + nth - 1], kinds[0][which]
        order = np.lexsort((at, k))
        at, k = at[order], k[order]
        head = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(k) != 0)))) if len(at) else at
        last = np.append(head, len(at))[1:] - 1
        return at[head], at[last] - at[head] + 2 * k[head], k[head]


def _ranges(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 to n[0], 1 to n[1], ...; to which entry each belongs)."""
    n = np.maximum(n, 0)
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + 1, which


def _smallest_primes(most: int) -> np.ndarray:
    out = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if out[p] == p:
            own = out[p * p :: p]
            own[own == np.arange(p * p, most + 1, p)] = p
    return out


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def find(texts: list[list[str]], least: int = LEAST, times: int = TIMES) -> dict[int, list[Run]]:
    """Runs of each text (a list of words) that has any, by start and period."""
    if least < 2 or times < 2:
        raise ValueError("runs hold two periods at least")
    number = _Numbers()
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    words = np.fromiter((n for t in texts for n in map(number.__getitem__, t)), dtype=np.int64, count=int(first[-1]))
    at, stretch = candidates(words, np.repeat(np.arange(len(texts)), np.diff(first)), least, times)
    if not len(at):
        return {}
    head = np.flatnonzero(np.concatenate(([True], np.diff(stretch) != 0)))
    longest = int(np.diff(np.append(head, len(at))).max())
    place = np.arange(len(at)) + np.cumsum(np.concatenate(([True], np.diff(stretch) != 0)))  # a separator before each stretch
    n = int(place[-1]) + 2
    sequence, back = len(number) + np.arange(n), np.zeros(n, dtype=np.int64)
    sequence[place], back[place] = words[at], at
    start, length, period = Sequence(sequence).runs(longest // times)
    keep = length >= np.maximum(least, times * period)
    start, length, period = back[start[keep]], length[keep], period[keep]
    text = np.searchsorted(first, start, side="right") - 1
    out: dict[int, list[Run]] = {}
    for t, *run in sorted(zip(text.tolist(), (start - first[text]).tolist(), period.tolist(), length.tolist(), strict=True)):
        out.setdefault(t, []).append((run[0], run[2], run[1]))
    return out


# --- over a table


def collapsed(words: list[str], runs: list[Run]) -> str:
    """The words that no run contains after its first period, joined by single spaces."""
    if not runs:
        return " ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return " ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def spans(words: list[str], runs: list[Run]) -> dict:
    return {"runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": collapsed(words, runs)}


def digests(words: list[str], runs: list[Run]) -> dict:
    """The run with the greatest exponent, and digests of all runs and of the collapsed text."""
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    said = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    row = dict(zip(("start", "length", "period"), best or (None,) * 3, strict=True))
    return {
        "n_runs": len(runs), **row, "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256(said.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
    }


Finish = Callable[[list[str], list[Run]], dict]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")
_FIELDS: dict[Finish, tuple[str, list[tuple[str, pa.DataType]]]] = {
    spans: ("runs array<struct<start: long, length: long, period: long>>, collapsed string", [("runs", pa.list_(_RUN)), ("collapsed", pa.string())]),
    digests: (
        ", ".join(f"{c} long" for c in _NUMBERS) + ", runs_sha256 string, collapsed_sha256 string",
        [*((c, pa.int64()) for c in _NUMBERS), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())],
    ),
}


def detect(docs: DataFrame, finish: Finish = spans, edit: Callable[[object, list[str]], list[str]] | None = None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id and what `finish` makes of a text's words and runs (spans: both as they are; digests: the greatest run and
    hashes). edit(doc_id, words) may change the words first."""
    schema, fields = _FIELDS[finish]

    @trimmed
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in by_bytes(batches, "text", STEP):
            texts = [WORD.findall(t or "") for t in some.column("text").to_pylist()]
            if edit is not None:
                texts = [edit(d, words) for d, words in zip(some.column("doc_id").to_pylist(), texts, strict=True)]
            found = find(texts, least, times)
            rows = pa.RecordBatch.from_pylist([finish(words, found.get(k, [])) for k, words in enumerate(texts)], pa.schema(fields))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), *rows.columns], ["doc_id", *rows.schema.names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")
