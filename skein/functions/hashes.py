"""Hash expressions: digests, keyed unit intervals, split choice, MinHash."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FIVE_WAY = (("train", 0.91), ("validation", 0.94), ("test", 0.97), ("probe", 0.99), ("cloze_reserve", 1.0))
THREE_WAY = (("train", 0.94), ("validation", 0.97), ("test", 1.0))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def hmac_sha256(key: str, message: Column) -> Column:
    """Hex HMAC-SHA256 from two nested digests; Spark has no HMAC function."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))), 256)


def unit_interval(key: str, message: Column) -> Column:
    """A keyed hash as a number in [0, 1): the first eight bytes over 2**64."""
    return F.conv(F.substring(hmac_sha256(key, message), 1, 16), 16, 10).cast("double") / float(1 << 64)


def keyed_split(key: str, algorithm: str, group: Column, bounds=FIVE_WAY) -> Column:
    """The split of a group by its keyed hash; the same for every record of the group."""
    u = unit_interval(key, F.concat(F.lit(f"{algorithm}|"), group))
    out = F.lit(bounds[-1][0])
    for name, upto in reversed(bounds[:-1]):
        out = F.when(u < upto, name).otherwise(out)
    return out


# The generator and its ranges, so that signatures equal those made elsewhere.
def minhash_coefficients(n: int = 64, seed: int = 17012) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, (1 << 32) - 1), rng.randrange(0, (1 << 32) - 1)) for _ in range(n)]


def _low_words(grams, digest: str) -> bytes:
    if digest == "md5":
        return b"".join(hashlib.md5(g.encode()).digest()[:4] for g in grams)
    return b"".join(hashlib.blake2s(g.encode(), digest_size=8).digest()[4:] for g in grams)


def minhash(text: Column, words: int = 5, n: int = 64, seed: int = 17012, digest: str = "blake2s") -> Column:
    """n minima of (a * h + b) mod 2**32 over a text's runs of lower-cased words.

    h is the low word of a run's 64-bit BLAKE2s, or the first of its MD5. A
    text of fewer words is one run; one without words has all ones; null stays
    null. Runs are made where they are hashed, so only signatures leave Python.
    """
    a, b = (np.array(x, np.uint64)[:, None] for x in zip(*minhash_coefficients(n, seed)))

    def one(t: str | None):
        if t is None:
            return None
        w = re.findall(r"\S+", t.lower())
        if not w:
            return [0xFFFFFFFF] * n
        grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
        h = np.frombuffer(_low_words(grams, digest), ">u4").astype(np.uint64)
        return ((a * h[None, :] + b) & np.uint64(0xFFFFFFFF)).min(axis=1).astype(np.int64)

    def signature(rows: pd.Series) -> pd.Series:
        return rows.map(one)

    return F.pandas_udf(signature, "array<long>")(text)


def agreement(x: Column, y: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e) / F.size(x)
