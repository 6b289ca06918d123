"""Near-duplicate records: universal hash minima, bands, verification, components.

A record's set is all runs of five words. Each of BANDS * ROWS universal hash
functions (multiply and add modulo 2**64) gives the set one minimum; 16 bits
of each make the signature. Records that agree in all ROWS minima of some band
are candidates; candidates are dropped when their whole signatures, by the low
byte of each minimum, agree too little, and the rest compared exactly, set
against set. A band that more than MOST records share is spread over salts
where all its pairs are asked for, and linked as a star where groups are.
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
from skein.operators.components import connected_components
from skein.storage import bucketed, written

WORDS, LEAST_WORDS = 5, 20
#: A pair at similarity 0.70 meets in some band with probability 0.9998, one at 0.80 with 1 - 5e-8.
ROWS, BANDS, SEED = 4, 32, 17012
#: Records of one band up to which they are paired as they are.
MOST = 64
#: Signatures of a pair at the threshold agree in fewer places than this many standard deviations below it with probability 3e-5.
SLACK = 4.0


def coefficients(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def signatures(texts: list[str], words: int = WORDS, n: int = ROWS * BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """16-bit signatures (texts x n) of those texts that have a set, word counts and word-sequence hashes."""
    text, h, counts, sequence = ta.shingles(texts, words)
    sig = np.zeros((len(texts), n), np.uint16)
    if len(h):
        some = np.flatnonzero(np.bincount(text, minlength=len(texts)))
        first = np.searchsorted(text, some)
        for i, (a, b) in enumerate(zip(*coefficients(n))):
            low = np.minimum.reduceat((h * a + b) >> np.uint64(16), first)
            sig[some, i] = (low ^ (low >> np.uint64(20))).astype(np.uint16)
    return sig, counts, sequence


def signature_table(corpus: Corpus, words: int = WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(class, seq, low, high) of the classes with `least_words` words; seq is equal where the word sequence is; low and high are the bytes of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch["text"].to_pylist(), batch["class"].to_numpy()
            for at in range(0, len(texts), 128):
                sig, counts, seq = signatures(texts[at : at + 128], words)
                ok = np.flatnonzero(counts >= max(least_words, words))
                if len(ok):
                    parts = (pa.array([r.tobytes() for r in (sig[ok] >> shift).astype(np.uint8)], pa.binary()) for shift in (0, 8))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at + ok]), pa.array(seq[ok].view(np.int64)), *parts], names=["class", "seq", "low", "high"])

    return written(corpus.texts.mapInArrow(run, "class long, seq long, low binary, high binary"))


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, member) of every band of every signature."""
    for batch in batches:
        if batch.num_rows:
            low, high = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.uint64) for c in ("low", "high"))
            minima = low | (high << ta.U(8))
            h = sum(minima[:, :, i] << ta.U(16 * i) for i in range(ROWS))
            h = ta.mix(h * ta.BASE + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * ta.U(0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(batch["class"].to_numpy(), BANDS))], names=["h", "member"])


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch["ta"].to_pylist(), batch["tb"].to_pylist()
            for at in range(0, len(a), 64):
                x, y = a[at : at + 64], b[at : at + 64]
                n = len(x)
                text, h = ta.distinct(*ta.shingles(x + y, WORDS)[:2])
                size = np.bincount(text, minlength=2 * n)
                pair, both = ta.distinct_counts(text % n, h, n)
                union = size[:n] + size[n:] - both
                sim = both / np.maximum(union, 1)
                ok = np.flatnonzero((sim >= threshold) & (union > 0))
                if len(ok):
                    yield pa.RecordBatch.from_arrays([batch["ka"].take(pa.array(at + ok)), batch["kb"].take(pa.array(at + ok)), pa.array(sim[ok])], names=["ka", "kb", "similarity"])

    return run


def _agreeing(own: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose signatures agree about as often as the threshold demands: chance agreement of bytes only adds to that."""
    n = ROWS * BANDS
    need = int(np.ceil(n * threshold - SLACK * np.sqrt(n * threshold * (1 - threshold))))

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, n) for c in ("sa", "sb"))
                ok = np.flatnonzero((x == y).sum(axis=1) >= need)
                yield pa.RecordBatch.from_arrays([batch["ka"].take(pa.array(ok)), batch["kb"].take(pa.array(ok))], names=["ka", "kb"])

    signed = pairs.join(own.select(F.col("class").alias("ka"), F.col("low").alias("sa")), "ka").join(own.select(F.col("class").alias("kb"), F.col("low").alias("sb")), "kb")
    return signed.mapInArrow(agree, "ka long, kb long")


def verified(corpus: Corpus, own: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(ka, kb, similarity) of the pairs with at least the threshold's intersection over union."""
    texts = corpus.texts
    full = _agreeing(own, pairs, threshold).join(texts.select(F.col("class").alias("ka"), F.col("text").alias("ta")), "ka").join(texts.select(F.col("class").alias("kb"), F.col("text").alias("tb")), "kb")
    return full.mapInArrow(_verify(threshold), "ka long, kb long, similarity double")


def word_classes(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """(class, low, high), in buckets of the class, one class a word sequence; and (class, rep): the class that stands for each.

    Records without `LEAST_WORDS` words (null and blank texts among them) have no class here.
    """
    table = signature_table(corpus)
    reps = table.groupBy("seq").agg(F.min("class").alias("rep"))
    of_class = written(table.select("class", "seq").join(reps, "seq").select("class", "rep"))
    own = bucketed(table.drop("seq").join(of_class.where("class = rep").select("class"), "class", "left_semi"), "class")
    return own, of_class


def band_pairs(own: DataFrame) -> DataFrame:
    """(ka, kb), each once, of all that share a band."""
    made = own.mapInArrow(_band_rows, "h long, member long")
    met = written(meetings(own.mapInArrow(cut_down(_band_rows, MOST), "h long, member long"), MOST))
    return pairs_of(met).union(salted_pairs(made.join(common_keys(met), "h", "left_semi"))).distinct()


def near_duplicate_pairs(corpus: Corpus, threshold: float = 0.7) -> DataFrame:
    """(a, b), a < b: all pairs of records whose sets have at least the threshold's intersection over union."""
    own, of_class = word_classes(corpus)
    links = verified(corpus, own, band_pairs(own), threshold)
    members = corpus.members.select("id", "class").join(of_class, "class").select("id", F.col("rep").alias("class"))
    return expand_pairs(links, members, within=members)


def near_duplicate_groups(corpus: Corpus, threshold: float = 0.8) -> DataFrame:
    """One row per record (id, group_id, group_size, is_representative).

    Groups are the connected components of the links of at least the
    threshold between different texts, with all copies; group_id is the least
    id in the group, its representative the longest text, ties to the least
    id. Records outside all groups are their own. Each band's members are
    linked to its least one first. Pairs are made only of members of a band
    whom that has left in different groups, so many edited copies of one text
    cost a comparison each, and no link that joins two groups is lost.
    """
    own, of_class = word_classes(corpus)
    bands = written(own.mapInArrow(_band_rows, "h long, member long"))
    lead = bands.groupBy("h").agg(F.min("member").alias("ka"), F.max("member").alias("last")).where("ka <> last").select("h", "ka")
    star = written(verified(corpus, own, bands.join(lead, "h").where("ka <> member").select("ka", F.col("member").alias("kb")).distinct(), threshold).select("ka", "kb"))
    comp = written(connected_components(star, "ka", "kb"))
    parted = bands.join(comp.select(F.col("node").alias("member"), "component"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    torn = parted.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("h")
    left = written(parted.join(torn, "h", "left_semi"))
    across = salted_pairs(left, group="component")
    comp = connected_components(star.union(verified(corpus, own, across, threshold).select("ka", "kb")), "ka", "kb")
    by = (
        corpus.members.select("id", "class", "chars")
        .join(of_class, "class", "left")
        .join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .withColumn("key", F.coalesce(F.concat(F.lit("c"), F.coalesce("component", "rep").cast("string")), F.concat(F.lit("i"), "id")))
    )
    groups = by.groupBy("key").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"), F.min(F.struct((-F.col("chars")).alias("c"), "id"))["id"].alias("best"))
    return by.join(groups, "key").select("id", "group_id", "group_size", (F.col("id") == F.col("best")).alias("is_representative"))
