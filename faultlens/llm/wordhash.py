"""Vectorised word splitting and hashing over concatenated UTF-8 texts.

Words are runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z.
Both rules concern ASCII bytes only, so they may be applied to UTF-8 directly.
Everything works on one flat buffer that holds many texts; no per-word Python.
"""

from __future__ import annotations

import numpy as np

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)
_GAP = 1  # one separator byte between texts

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0] = 1
        filled = 1
        while filled < size:
            step = np.uint64(pow(base, filled, 1 << 64))
            more = min(filled, size - filled)
            have[filled : filled + more] = have[:more] * step
            filled += more
        _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def flatten(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buffer, starts): texts one after the other with a space after each; starts has one more entry, the end."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths + _GAP, out=starts[1:])
    return np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8), starts


def words(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first): word hashes with their byte spans; first[k] is the index of text k's first word."""
    (value,), begin, end, first = spans(buffer, starts, _IS_SPACE, (None,))
    return value, begin, end, first


def spans(
    buffer: np.ndarray, starts: np.ndarray, breaks: np.ndarray, prefixes: tuple[int | None, ...]
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start, end, first) of the runs of bytes not in `breaks` (a flag for each byte value); for each of
    `prefixes` the hashes of the runs' first so many bytes (None: of the whole run)."""
    low = _LOWER[buffer]
    space = breaks[low]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    total = np.empty(len(low) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers(_MULT, len(low)), out=total[1:])
    scale = powers(_INV, len(low) + 1)[begin]
    hashes = []
    for most in prefixes:
        last = end if most is None else np.minimum(end, begin + most)
        salt = np.uint64(0 if most is None else mix64(np.array([most], dtype=np.uint64))[0])
        value = (total[last] - total[begin]) * scale + salt
        hashes.append(mix64(value + (last - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
    return hashes, begin, end, np.searchsorted(begin, starts)


def windows(value: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text): hashes of all runs of `width` words inside a text, or of the whole sequence where a text has
    fewer (none where it has no word); text is the index of the text, ascending."""
    count = np.diff(first)
    n = len(value)
    weights = [np.uint64(pow(_MULT, 2 * j + 3, 1 << 64)) for j in range(width)]
    run = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for j, w in enumerate(weights):
        run += value[j : n - width + 1 + j] * w
    many = np.maximum(count - width + 1, 0)
    text = np.repeat(np.arange(len(count)), many)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    full = mix64(run[first[:-1][text] + offset]) if len(text) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((count > 0) & (count < width))
    if not len(short):
        return full, text
    own = np.zeros(len(short), dtype=np.uint64)
    for j in range(width - 1):
        has = count[short] > j
        own[has] += value[first[short[has]] + j] * weights[j]
    own = mix64(own + (count[short].astype(np.uint64) << np.uint64(56)))
    at = np.concatenate((text, short))
    order = np.argsort(at, kind="stable")
    return np.concatenate((full, own))[order], at[order]


def sequence_keys(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2) uint64: a 128-bit key of each text's word sequence; (0, 0) for a text without words."""
    count = np.diff(first)
    keys = np.zeros((len(count), 2), dtype=np.uint64)
    n = len(value)
    for side, base in enumerate((_MULT, 0xC2B2AE3D27D4EB4F | 1)):
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        source = value if side == 0 else mix64(value ^ np.uint64(0x5851F42D4C957F2D))
        np.cumsum(source * powers(base, n), out=total[1:])
        own = (total[first[1:]] - total[first[:-1]]) * powers(pow(base, -1, 1 << 64), n + 1)[first[:-1]]
        keys[:, side] = mix64(own + count.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    keys[count == 0] = 0
    return keys


def distinct_sets(value: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first): each text's distinct hashes in ascending order; first[k]:first[k+1] are text k's."""
    order = np.argsort(value)  # then a stable sort by text, which is quick on small integers
    small = text.astype(np.uint16) if n_texts <= 1 << 16 else text
    order = order[np.argsort(small[order], kind="stable")]
    v, t = value[order], text[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    v, t = v[keep], t[keep]
    return v, np.searchsorted(t, np.arange(n_texts + 1))
