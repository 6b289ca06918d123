"""Evaluation records that reappear in training records, by winnowing fingerprints.

The fingerprints of a text are hashes of five-word runs, the least of every
window of six, in an order that puts rare runs first: a frequency sketch of
bounded size gives every run a level. A common stretch of ten words therefore
yields a common fingerprint, and that is a rare one wherever the stretch holds
a rare run. Evaluation and training records are joined on fingerprints; for
each pair met often enough, the common runs are the seeds, which are chained
where they run alike in both texts and extended word by word into aligned
stretches; the five-word sets are compared exactly.

How often is enough follows from the share asked for. Of d distinct runs at
most l = floor((1 - s) d) may be missing. Only windows whose runs all come once
in the record count: an edit among them breaks at least four runs, each of
which is then missing, so at most l + 5 * (l // 4) of these windows are lost (an
edit that touches a repeated run loses no more windows than it breaks runs that
come once). Windows of nothing but common runs (stock phrases, notices) are
taken off; each fingerprint accounts for at most six of the rest.

Where nothing remains, because a record repeats itself or is made of stock
phrases, it is joined on runs instead, which needs no such argument: of its
l + k rarest runs at least k are in every training record that has the share.
Training records hand on only fingerprints that evaluation records may be
found by, and every run that may be one of the rarest, by a filter of bounded
size: held-out sets are small beside a corpus. With very many evaluation
records the filter lets more through, and the join does its work. So no pair
is lost and no stock phrase has to be paired for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import textarrays as ta
from skein.llm.classes import Corpus
from skein.llm.sketch import cells, frequency_levels, hot_level, marked, marks_of
from skein.storage import bucketed, written

WORDS, WINDOW, LEAST_WORDS = 5, 6, 20
#: Runs in a cell of 64 occurrences or more, and well above the mean cell, are common.
COMMON = 7
#: The most runs that a pair joined on runs must share, as far as they are rare.
MORE_RUNS = 4
TRAIN, EVALUATION = "train", ("validation", "test", "probe", "cloze_reserve")


#: Added to a run before it is put into the filter as a key of its own, so that it differs from a fingerprint.
AS_RUN = ta.U(0xA24BAED4963EE407)


def fingerprints(texts: list[str], levels: np.ndarray, common: int = 256, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the fingerprints below the common level of all texts with enough words; with marks, of those and other runs that the filter may have."""
    text, h, counts, _ = ta.shingles(texts, WORDS)
    if len(h) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    pick = ta.selected(_order(h, levels), WINDOW) & (levels[cells(h)] < common)
    if marks is not None:
        pick[pick] = marked(marks, h[pick])
        pick |= marked(marks, h + AS_RUN)
    pick &= counts[text] >= LEAST_WORDS
    return ta.distinct(text[pick], h[pick])


def _order(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return (levels[cells(h)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))


def _repeated(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For every run, whether its text has it more than once."""
    order = np.lexsort((h, text))
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(h), bool)
    out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    return out


def evaluation_keys(texts: list[str], levels: np.ndarray, common: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of the keys that evaluation texts are found by, for each text how many a pair must share, and whether its keys are its rarest runs."""
    text, h, counts, _ = ta.shingles(texts, WORDS)
    if len(h) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    each, run = ta.distinct(text, h)
    size = np.bincount(each, minlength=len(texts))
    lost = np.floor((1 - least) * size + 1e-9).astype(np.int64)
    broken = lost + (WINDOW - 1) * (lost // 4)
    low = ta.sliding(levels[cells(h)], WINDOW, np.minimum)
    first, last = text[: len(low)], text[WINDOW - 1 :]
    once = (first == last) & ~ta.sliding(_repeated(text, h), WINDOW, np.logical_or)
    need = np.ceil((np.bincount(first[once & (low < common)], minlength=len(texts)) - broken) / WINDOW).astype(np.int64)
    by_runs = need < 1
    rare = np.bincount(each[levels[cells(run)] < common], minlength=len(texts))
    need = np.where(by_runs, np.clip(rare - lost, 1, MORE_RUNS), need)
    t, f = fingerprints(texts, levels, common)
    keep = ~by_runs[t]
    order = np.lexsort((_order(run, levels), each))
    each, run = each[order], run[order]
    rank = np.arange(len(each)) - (np.cumsum(size) - size)[each]
    rarest = by_runs[each] & (rank < (lost + need)[each]) & (counts[each] >= LEAST_WORDS)
    return np.concatenate((t[keep], each[rarest])), np.concatenate((f[keep], run[rarest])), need, by_runs


def _evaluation_rows(levels, common: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch["text"].to_pylist(), batch["class"].to_numpy()
            for at in range(0, len(texts), 128):
                text, h, need, by_runs = evaluation_keys(texts[at : at + 128], levels.value, common, least)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[at + text]), pa.array(need[text].astype(np.int32)), pa.array(by_runs[text])], names=["h", "class", "need", "by_runs"])

    return run


def _training_rows(levels, common: int, marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch["text"].to_pylist(), batch["class"].to_numpy()
            for at in range(0, len(texts), 128):
                text, h = fingerprints(texts[at : at + 128], levels.value, common, marks.value)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[at + text])], names=["h", "class"])

    return run


def aligned_words(e: np.ndarray, t: np.ndarray) -> int:
    """Words of e in stretches that run alike in t: seeds of five words, chained by diagonal and extended."""
    if len(e) < WORDS or len(t) < WORDS:
        return 0
    ge, gt = (sum(mixed * ta.U(2 * i + 3) for i, mixed in enumerate(ta.mix(w)[i : len(w) - WORDS + 1 + i] for i in range(WORDS))) for w in (e, t))
    order = np.argsort(gt, kind="stable")
    lo, hi = np.searchsorted(gt[order], ge, "left"), np.searchsorted(gt[order], ge, "right")
    covered = np.zeros(len(e), bool)
    i, last = 0, 0
    while i < len(ge):
        if hi[i] == lo[i]:
            i += 1
            continue
        hits = order[lo[i] : hi[i]]
        j = int(hits[np.argmin(np.abs(hits - (i + last)))])  # the seed nearest to the chain so far
        m = min(len(e) - i, len(t) - j)
        differ = np.flatnonzero(e[i : i + m] != t[j : j + m])
        n = int(differ[0]) if len(differ) else m
        m = min(i, j)
        differ = np.flatnonzero(e[i - m : i][::-1] != t[j - m : j][::-1])
        back = int(differ[0]) if len(differ) else m
        covered[i - back : i + n] = True
        last, i = j - i, i + max(1, n - WORDS + 1)
    return int(covered.sum())


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, t = batch["te"].to_pylist(), batch["tt"].to_pylist()
            for at in range(0, len(e), 64):
                x, y = e[at : at + 64], t[at : at + 64]
                n = len(x)
                text, h = ta.distinct(*ta.shingles(x + y, WORDS)[:2])
                size = np.bincount(text, minlength=2 * n)[:n]
                _, both = ta.distinct_counts(text % n, h, n)
                share = both / np.maximum(size, 1)
                ok = np.flatnonzero((share >= least) & (size > 0))
                if not len(ok):
                    continue
                number, w = ta.words_of([x[i] for i in ok] + [y[i] for i in ok])
                edge = np.searchsorted(number, np.arange(2 * len(ok) + 1))
                words = [w[edge[i] : edge[i + 1]] for i in range(2 * len(ok))]
                aligned = [aligned_words(words[i], words[i + len(ok)]) for i in range(len(ok))]
                yield pa.RecordBatch.from_arrays(
                    [batch["ke"].take(pa.array(at + ok)), batch["kt"].take(pa.array(at + ok)), pa.array(share[ok]), pa.array(aligned, pa.int64()), pa.array([len(v) for v in words[: len(ok)]], pa.int64())],
                    names=["ke", "kt", "share", "aligned_words", "eval_words"],
                )

    return run


def leaking_pairs(corpus: Corpus, least: float = 0.7) -> DataFrame:
    """(eval_id, train_id, share, aligned_words, eval_words) of all pairs with `least` of the evaluation set in training.

    corpus.members must have `split` as compared; null or other splits take no
    part, nor do records with null text or under 20 words. Copies are members
    of one class and all come out. An empty side gives an empty result.
    """
    members = corpus.members.where("class is not null").select("id", "class", "split")
    sides = bucketed(members.groupBy("class").agg(F.bool_or(F.col("split").isin(*EVALUATION)).alias("e"), F.bool_or(F.col("split") == TRAIN).alias("t")).where("e or t"), "class")
    side = lambda where: corpus.texts.join(sides.where(where).select("class"), "class", "left_semi")
    e_text, t_text = side("e"), side("t")
    share = corpus.texts.sparkSession.sparkContext.broadcast

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        part = batch["text"].to_pylist()
        return np.concatenate([np.empty(0, np.uint64), *(ta.shingles(part[i : i + 128], WORDS)[1] for i in range(0, len(part), 128))])

    found = frequency_levels(side("e or t").select("text"), runs)
    common, levels = hot_level(found, COMMON, 3), share(found)
    keys = written(e_text.mapInArrow(_evaluation_rows(levels, common, least), "h long, class long, need int, by_runs boolean"))
    marks = share(marks_of(keys.select("h", "by_runs"), lambda batch: batch["h"].to_numpy().view(np.uint64) + np.where(batch["by_runs"].to_numpy(zero_copy_only=False), AS_RUN, ta.U(0))))
    e = keys.drop("by_runs").withColumnRenamed("class", "ke")
    t = t_text.mapInArrow(_training_rows(levels, common, marks), "h long, class long").withColumnRenamed("class", "kt")
    met = e.join(t, "h").groupBy("ke", "kt").agg(F.count("*").cast("int").alias("n"), F.first("need").alias("need")).where("n >= need").select("ke", "kt")
    texts = corpus.texts
    full = met.join(texts.select(F.col("class").alias("ke"), F.col("text").alias("te")), "ke").join(texts.select(F.col("class").alias("kt"), F.col("text").alias("tt")), "kt")
    links = full.mapInArrow(_compare(least), "ke long, kt long, share double, aligned_words long, eval_words long")
    return (
        links.join(members.where(F.col("split").isin(*EVALUATION)).select(F.col("class").alias("ke"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split")), "ke")
        .join(members.where(F.col("split") == TRAIN).select(F.col("class").alias("kt"), F.col("id").alias("train_id")), "kt")
        .select("eval_id", "train_id", "eval_split", F.round("share", 6).alias("share"), "aligned_words", "eval_words")
    )


def leak_report(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(split, source, eval_records, leaked_records, pairs): leaks per evaluation pool and source of the evaluation record.

    sources: (id, split, source) of all records; a null source is a group of its own.
    """
    per = pairs.groupBy(F.col("eval_id").alias("id")).agg(F.count("*").alias("n"))
    return (
        sources.where(F.col("split").isin(*EVALUATION))
        .join(per, "id", "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("eval_records"), F.count("n").alias("leaked_records"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs"))
    )
