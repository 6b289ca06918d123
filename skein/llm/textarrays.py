"""Array arithmetic over whole batches of texts.

A batch of texts becomes one array of code points with a zero after every
text, and everything after that (rolling hashes, window minima, words and
shingles) is numpy over that array: no Python loop over characters or words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
TOP = U(0xFFFFFFFFFFFFFFFF)
_cache: dict = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); works in place on a copy."""
    h = h ^ (h >> U(31))
    h *= U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    h ^= h >> U(33)
    return h


def codes_of(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each ended by a zero; starts and ends of the texts.

    A zero inside a text counts as a blank, so that ends can be found again
    after lower-casing, which may change lengths.
    """
    joined = "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    if lower:
        joined = joined.lower()
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    ends = np.flatnonzero(codes == 0)
    return codes, np.concatenate(([0], ends[:-1] + 1)), ends


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k code points, by doubling; length len(codes) - k + 1."""
    if len(codes) < k:
        return np.empty(0, U)
    h, size, power = codes.astype(U) + U(1), 1, BASE
    out, done = None, 0
    # out covers `done` characters; bits of k from the lowest upwards
    while True:
        if k & size:
            out = h.copy() if out is None else out[: len(codes) - done - size + 1] * power + h[done : len(codes) - size + 1]
            done += size
        if size * 2 > k:
            return mix(out[: len(codes) - k + 1])
        h = h[:-size] * power + h[size:]
        size *= 2
        power = U(int(power) ** 2 % (1 << 64))


def sliding(h: np.ndarray, w: int, op) -> np.ndarray:
    """op (minimum or maximum) over every window of w values, by doubling."""
    size = 1
    while size * 2 <= w:
        h = op(h[:-size], h[size:])
        size *= 2
    return op(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def selected(h: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: True where a value is the least of some window of w values.

    h must end in at least w values of TOP after each text (see padded).
    """
    if len(h) < w:
        return np.zeros(len(h), bool)
    low = sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, U)
    high = sliding(np.concatenate((pad, low, pad)), w, np.maximum)
    return (high == h) & (h != TOP)


def anchors(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of the winnowed k-character anchors.

    Two texts with a common run of at least k + w - 1 characters share an anchor in it.
    """
    codes, starts, ends = codes_of(texts)
    h = rolling(codes, k)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    for e in ends:  # runs over the end of a text are none
        h[max(0, e - k + 1) : e + 1] = TOP
    at = np.flatnonzero(selected(h, w))
    text = np.searchsorted(ends, at)
    return text, at - starts[text], h[at]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 and its inverse to the same."""
    if len(_cache.get("pow", ())) < n:
        n = max(n, 1 << 17)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        for name, base in (("pow", BASE), ("inv", inverse)):
            p = np.full(n, base, U)
            p[0] = 1
            _cache[name] = np.multiply.accumulate(p)
    return _cache["pow"], _cache["inv"]


def alnum() -> np.ndarray:
    """For every code point, whether it is a letter or digit (classes L and N)."""
    if "alnum" not in _cache:
        import unicodedata

        _cache["alnum"] = np.array([unicodedata.category(chr(i))[0] in "LN" for i in range(0x110000)])
    return _cache["alnum"]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each word: maximal runs of letters and digits, lower-cased."""
    codes, _, _ = codes_of(texts, lower=True)
    is_word = alnum()[codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    pow_, inv = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U)
    np.cumsum((codes.astype(U) + U(0x5851F42D)) * pow_[: len(codes)], out=total[1:])
    h = mix((total[end] - total[begin]) * inv[begin] + (end - begin).astype(U))
    text = np.cumsum(codes == 0)[begin]
    return text, h


def shingles(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of all runs of n words, in order; words of each text; hash of each text's word sequence."""
    text, w = words_of(texts)
    counts = np.bincount(text, minlength=len(texts))
    sequence = np.zeros(len(texts), U)
    if len(w):
        first = np.cumsum(counts) - counts
        rank = np.arange(len(w)) - first[text]
        pow_, _ = powers(int(rank.max()) + 2)
        parts = mix(w ^ U(0xA5A5A5A5A5A5A5A5)) * pow_[rank + 1]
        some = counts > 0
        sequence[some] = np.add.reduceat(parts, first[some])
    sequence = mix(sequence + counts.astype(U))
    if len(w) < n:
        return np.empty(0, np.int64), np.empty(0, U), counts, sequence
    g = w[: len(w) - n + 1].copy()
    for i in range(1, n):
        g = g * BASE + w[i : len(w) - n + 1 + i]
    ok = text[: len(w) - n + 1] == text[n - 1 :]
    return text[:-n + 1][ok] if n > 1 else text[ok], mix(g[ok]), counts, sequence


def distinct(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (text, hash) once, ordered by text and hash."""
    if not len(h):
        return text, h
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
    return text[new], h[new]


def distinct_counts(pair: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many values each of n pairs has twice, where (pair, value) comes at most once from each side."""
    order = np.lexsort((h, pair))
    pair, h = pair[order], h[order]
    twice = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])
    return np.arange(n), np.bincount(pair[1:][twice], minlength=n)
