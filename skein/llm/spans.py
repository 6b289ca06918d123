"""Long exact spans shared between records, by relative Lempel-Ziv parsing.

Reference blocks are the anchors of a text: winnowed runs of K characters,
chosen so that any two texts with a common run of `least` characters have an
anchor of it in common. The index of all blocks is a table keyed by the
block's hash, over the whole corpus. It routes every text to just those
references that it shares a block with; against each it is then parsed
greedily into factors, the longest match at the place reached, the next factor
starting where the last ended. Factors are checked at their start as well,
since the end of an earlier factor may have cut them short.

Blocks that more than MOST texts have (a notice in a third of the corpus)
aren't paired directly. Their texts are looked up by the hashes of the whole
windows of `least` characters around the block: windows that two texts have
are shared, and what only looked alike drops out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import textarrays as ta
from skein.llm.classes import Corpus, expand_pairs
from skein.llm.meeting import common_keys, cut_down, meetings, pairs_of, salted_pairs
from skein.storage import written

#: Texts of one block up to which they are paired as they are.
MOST = 64


def block_size(least: int) -> tuple[int, int]:
    k = least // 2
    return k, least - k + 1


class _Runs:
    """Hashes of any run of a text, from sums over its prefixes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.size = codes, len(codes)
        pow_, self.inverse = ta.powers(self.size + 1)
        self.sums = np.zeros(self.size + 1, ta.U)
        np.cumsum((codes.astype(ta.U) + ta.U(1)) * pow_[: self.size], out=self.sums[1:])

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.inverse[at]


def _ahead(x: _Runs, i: int, y: _Runs, places: np.ndarray) -> tuple[int, int]:
    """The first of the places in y from which most characters agree with x from i, and how many do."""
    n = 0
    room = np.minimum(x.size - i, y.size - places)
    step = 1 << int(room.max()).bit_length()
    at = np.array([i])
    while step:
        fit = np.flatnonzero(room >= n + step)
        if len(fit):
            fit = fit[y.hashes(places[fit], n + step) == x.hashes(at, n + step)[0]]
            if len(fit):
                n += step
                places, room = places[fit], room[fit]
        step >>= 1
    j = int(places[0])
    differ = np.flatnonzero(x.codes[i : i + n] != y.codes[j : j + n])  # equal hashes of different text
    return j, int(differ[0]) if len(differ) else n


def factors(x: np.ndarray, y: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Factors (start in x, start in y, length) of at least `least` characters of x against y.

    Every window of `least` characters of x is looked up in y. At each place
    reached the longest match is taken, at its first place in y, and extended
    backwards into the factor before; the next one starts with the first
    window beyond it that y has. So every window that y has lies in a factor,
    however often either text repeats it.
    """
    hx, hy = ta.rolling(x, least), ta.rolling(y, least)
    if not len(hx) or not len(hy):
        return []
    order = np.argsort(hy, kind="stable")
    sorted_y = hy[order]
    lo, hi = np.searchsorted(sorted_y, hx, "left"), np.searchsorted(sorted_y, hx, "right")
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return []
    rx, ry = _Runs(x), _Runs(y)
    out, n = [], 0
    while n < len(found):
        i = int(found[n])
        j, length = _ahead(rx, i, ry, order[lo[i] : hi[i]])
        if length >= least:
            m = min(i, j)
            differ = np.flatnonzero(x[i - m : i][::-1] != y[j - m : j][::-1])
            back = int(differ[0]) if len(differ) else m
            out.append((i - back, j - back, back + length))
        n = int(np.searchsorted(found, i + max(1, length - least + 1)))
    return out


def _anchor_rows(least: int):
    k, w = block_size(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch["text"].to_pylist(), batch["class"].to_numpy()
            for at in range(0, len(texts), 256):
                text, _, h = ta.anchors(texts[at : at + 256], k, w)
                text, h = ta.distinct(text, h)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[at + text])], names=["h", "member"])

    return run


def _window_rows(least: int):
    """Of texts with some of their block hashes: (h, class, start) of all windows of `least` characters around those blocks."""
    k, w = block_size(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, t, wanted in zip(batch["class"].to_pylist(), batch["text"].to_pylist(), batch["blocks"].to_pylist()):
                codes, _, _ = ta.codes_of([t])
                _, pos, h = ta.anchors([t], k, w)
                pos = pos[np.isin(h, np.array(wanted, np.int64).view(np.uint64))]
                at = np.unique((pos[:, None] + np.arange(k - least, 1)).ravel())
                at = at[(at >= 0) & (at + least < len(codes))]
                full = ta.rolling(codes, least)[at]
                yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(np.full(len(at), c, np.int64)), pa.array(at)], names=["h", "class", "start"])

    return run


def routes(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(ka, kb), each once: classes that share a block of at most MOST texts; (h, class, start): windows around the other blocks."""
    blocks = written(texts.select("class", "text").mapInArrow(_anchor_rows(least), "h long, member long"))
    met = written(meetings(blocks.mapInArrow(cut_down(lambda batches: batches, MOST), "h long, member long"), MOST))
    held = blocks.join(common_keys(met), "h", "left_semi").groupBy(F.col("member").alias("class")).agg(F.collect_list("h").alias("blocks"))
    windows = held.join(texts.select("class", "text"), "class").mapInArrow(_window_rows(least), "h long, class long, start long")
    return pairs_of(met), windows


def candidate_pairs(texts: DataFrame, least: int) -> DataFrame:
    """(ka, kb) of the classes that share a reference block, or for common blocks a whole window, each pair once."""
    pairs, windows = routes(texts, least)
    return pairs.union(salted_pairs(windows.select("h", F.col("class").alias("member")).distinct())).distinct()


def spans_between(texts: DataFrame, pairs: DataFrame, least: int, both: bool = True) -> DataFrame:
    """Spans (class, start, length, ref_class, ref_start) of the pairs (ka, kb); of kb in ka as well if both."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
        for batch in batches:
            ka, kb = batch["ka"].to_pylist(), batch["kb"].to_pylist()
            rows = []
            for a, b, ta_, tb in zip(ka, kb, batch["ta"].to_pylist(), batch["tb"].to_pylist()):
                x, y = codes(ta_), codes(tb)
                rows += [(a, i, n, b, j) for i, j, n in factors(x, y, least)]
                if both:
                    rows += [(b, i, n, a, j) for i, j, n in factors(y, x, least)]
            if rows:
                c, i, n, r, j = (list(z) for z in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(j, pa.int64())], names=["class", "start", "length", "ref_class", "ref_start"])

    joined = pairs.join(texts.select(F.col("class").alias("ka"), F.col("text").alias("ta")), "ka").join(texts.select(F.col("class").alias("kb"), F.col("text").alias("tb")), "kb")
    return joined.mapInArrow(parse, "class long, start long, length long, ref_class long, ref_start long")


def _long(corpus: Corpus, least: int) -> DataFrame:
    return corpus.texts.where(F.length("text") >= least)


def shared_spans(corpus: Corpus, least: int = 160) -> DataFrame:
    """Spans (class, start, length, ref_class, ref_start) of the corpus's texts.

    Spans hold for both directions of every pair of classes: each row says
    that `length` characters (code points) from `start` of one text stand at
    `ref_start` of the other. Texts that are null or shorter than `least` have
    none. Copies aren't listed against each other, as they are members of one
    class. An empty corpus has no spans.
    """
    texts = _long(corpus, least)
    return spans_between(texts, candidate_pairs(texts, least), least)


def sharing_pairs(corpus: Corpus, least: int = 160) -> DataFrame:
    """(a, b), a < b: all pairs of records that have some same string of `least` characters."""
    texts = _long(corpus, least)
    pairs = spans_between(texts, candidate_pairs(texts, least), least, both=False).select(F.col("class").alias("ka"), F.col("ref_class").alias("kb"))
    members = corpus.members.where(F.col("class").isNotNull() & (F.col("chars") >= least))
    return expand_pairs(pairs, members, within=members)


def shared_coverage(corpus: Corpus, least: int = 160) -> DataFrame:
    """For every record (id, n_chars, shared_chars, shared_share, n_spans): how much of it stands in other records.

    Spans that overlap or touch are joined before they are counted. A text of
    `least` characters that another record has as a whole is one span. Records
    with null, blank or short texts have no spans and share 0. Texts are
    parsed against each other where at most MOST have a block; of more common
    blocks the windows that two classes have are counted as they are, so that
    nothing grows with the square of the texts that share a passage.
    """
    zero = F.lit(0).cast("long")
    texts = _long(corpus, least)
    pairs, windows = routes(texts, least)
    windows = written(windows)
    common = windows.groupBy("h").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("h")
    reach = (
        spans_between(texts, pairs, least)
        .select("class", "start", (F.col("start") + F.col("length")).alias("end"))
        .union(windows.join(common, "h", "left_semi").select("class", "start", F.col("start") + least))
        .groupBy("class", "start")
        .agg(F.max("end").alias("end"))  # at most one row a character
    )
    copied = corpus.members.where(F.col("class").isNotNull() & (F.col("chars") >= least)).groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class", F.lit(True).alias("copied"))
    merged = (
        reach.groupBy("class")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
        .select(
            "class",
            F.aggregate(
                "s",
                F.struct(zero.alias("n"), zero.alias("chars"), F.lit(-1).cast("long").alias("end")),
                lambda acc, x: F.struct(
                    (acc["n"] + F.when(x["start"] > acc["end"], 1).otherwise(0)).alias("n"),
                    (acc["chars"] + F.greatest(zero, x["end"] - F.greatest(x["start"], acc["end"]))).alias("chars"),
                    F.greatest(acc["end"], x["end"]).alias("end"),
                ),
            ).alias("u"),
        )
        .select("class", F.col("u.n").alias("spans"), F.col("u.chars").alias("chars_in"))
    )
    by = corpus.members.select("id", "class", F.col("chars").alias("n_chars")).join(merged, "class", "left").join(copied, "class", "left")
    out = by.withColumns({"shared_chars": F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("chars_in", zero)), "n_spans": F.when(F.col("copied"), F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero))})
    return out.select("id", "n_chars", "shared_chars", F.round(F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0), 6).alias("shared_share"), "n_spans")
