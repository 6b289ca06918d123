"""Interpolated Kneser-Ney models of several orders, fitted and scored together.

Words become numbers: the most frequent ones two bytes, the others 62 bits of
a hash beside them. Every token of a training or held-out document becomes one
window, the token with the words before it, and windows are moved once, sorted
and compressed in blocks, by the word before the token. All n-grams and
contexts of two words or more that end there then lie together, of every
length, so that their counts, continuation counts, totals and types come from
one chain of groupings, and no n-gram is moved or written. Held-out windows
meet their counts in the same place; these go, with the continuation counts of
single words, by token to where the probabilities are made. Windows behind a
word that very many have are spread by the word before it as well; only the
counts of such a word with its token are then in several places, and are
summed up with those of single words.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import written

#: Codes: below NONE a frequent word, then no word, then (two bytes only) a word whose hash stands beside.
NONE, BESIDE, RARE = 65_534, 65_535, 1 << 62
#: Windows that a task holds before it hands on its blocks.
CHUNK = 1 << 20
#: A word with more occurrences has its windows spread.
HOT = 1 << 20


def frequent_words(words: DataFrame, hot: int | None = None) -> tuple[list[str], int]:
    """The most frequent of the (word) rows, by count, as far as two bytes name them, and how many have more than `hot`.

    What words they are changes sizes only, no result. Of words with equal
    counts all are taken or none, so that nothing is sorted but the words taken.
    """
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")))
    least, taken = None, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect():
        taken += r.words
        if taken > NONE:
            break
        least = r.n
    rows = sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.word)) if least is not None else []
    return [r.word for r in rows], sum(r.n > (HOT if hot is None else hot) for r in rows)


def word_codes(df: DataFrame, words: str, frequent: list[str]) -> DataFrame:
    """df with the array of words replaced by `low` and `beside`: a two-byte code a word, and the hashes of the others."""
    share = df.sparkSession.sparkContext.broadcast(frequent)
    others = [c for c in df.columns if c != words]
    made: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.update((w, i) for i, w in enumerate(share.value))
        for b in batches:
            lists = b.column(b.schema.get_field_index(words))
            names = lists.flatten().dictionary_encode()
            each = np.array([made[w] if w in made else RARE | int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") >> 2 for w in names.dictionary.to_pylist()], np.int64)
            codes = each[names.indices.to_numpy(zero_copy_only=False)] if len(names) else np.empty(0, np.int64)
            low, rare = np.where(codes >= RARE, BESIDE, codes).astype(np.uint16), codes >= RARE
            ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            starts, at, hashes = np.concatenate(([0], ends[:-1])), np.concatenate(([0], np.cumsum(rare))), codes[rare]
            there = lists.is_valid().to_pylist()
            a = [low[s:e].tobytes() if v else None for s, e, v in zip(starts, ends, there)]
            z = [hashes[at[s] : at[e]].tobytes() if v else None for s, e, v in zip(starts, ends, there)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in others), pa.array(a, pa.binary()), pa.array(z, pa.binary())], names=[*others, "low", "beside"])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != words)
    return df.mapInArrow(run, f"{schema}, low binary, beside binary")


def _packed(rows: np.ndarray) -> tuple[int, bytes]:
    raw = rows.tobytes()
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _part(codes: np.ndarray, parts: int) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


_BLOCK = "part long, kind string, n long, size long, data binary, beside binary"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "kind", "n", "size", "data", "beside"])


def _codes_block(part: int, kind: str, m: np.ndarray) -> tuple:
    """A block of codes, a column a window: two bytes a code, hashes of the other words beside them."""
    rare = m >= RARE
    size, data = _packed(np.where(rare, BESIDE, m).astype(np.uint16))
    return part, kind, m.shape[1], size, data, m[rare].tobytes()


def _windows(order: int, parts: int, hot: int) -> Callable:
    """Blocks of windows by the word before the token, behind codes below hot by two words: rows t, c1 (the word before), c2 and so on."""

    def blocks(docs: list[tuple[bool, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, own in (("train", [d for t, d in docs if t]), ("held", [d for t, d in docs if not t])):
            if not own:
                continue
            codes = np.concatenate(own)
            sizes = np.array([len(d) for d in own])
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            m = np.full((order, len(codes)), NONE, np.int64)
            m[0] = codes
            for k in range(1, order):
                m[k, k:] = np.where(place[k:] >= k, codes[:-k], NONE)
            m = m[:, place >= 1]
            if not m.shape[1]:
                continue
            part = _part(np.where(m[1] < hot, (m[1] + 1) * 0x5851F42D4C957F2D + (m[2] if order > 2 else 0), m[1]), parts)
            by = np.lexsort((m[0], m[1], part))
            m, part = m[:, by], part[by]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield _table([_codes_block(int(part[a]), kind, m[:, a:b])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for r in b.to_pylist():
                codes = np.frombuffer(r["low"], np.uint16).astype(np.int64)
                codes[codes == BESIDE] = np.frombuffer(r["beside"], np.int64)
                held.append((r["training"], codes))
                n += len(codes)
                if n >= CHUNK:
                    yield from blocks(held)
                    held, n = [], 0
        yield from blocks(held)

    return run


def _ids(key: np.ndarray) -> tuple[np.ndarray, int]:
    u, at = np.unique(key, return_inverse=True)
    return at.astype(np.int32), len(u)


def _sums(at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=weight, minlength=n).astype(np.int64)


def _levels(orders: list[int]) -> list[tuple[str, int]]:
    """The tables that models of these orders need beyond single words: continuation counts (k) and plain counts (r)."""
    return [("k", n) for n in range(2, max(orders))] + [("r", n) for n in sorted(orders)]


def _unpacked(table: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Small codes of all windows in a table of blocks, which of them are training's, and the hashes that the codes above BESIDE stand for."""
    rows = [r for r in table.to_pylist() if r["kind"] in ("train", "held")]
    beside = [np.frombuffer(r["beside"], np.int64) for r in rows]
    hashes = np.unique(np.concatenate(beside)) if rows else np.empty(0, np.int64)
    m = np.empty((order, sum(r["n"] for r in rows)), np.int32)
    training = np.empty(m.shape[1], bool)
    at = 0
    for r, z in zip(rows, beside):
        own = np.frombuffer(pa.decompress(r["data"], r["size"], codec="zstd", asbytes=True), np.uint16).reshape(order, r["n"]).astype(np.int32)
        own[own == BESIDE] = BESIDE + 1 + np.searchsorted(hashes, z)
        m[:, at : at + r["n"]] = own
        training[at : at + r["n"]] = r["kind"] == "train"
        at += r["n"]
    return m, training, hashes


def _counted(orders: list[int], parts: int, hot: int) -> Callable:
    """Of the windows behind one word or more: how many n-grams have one and two (kind k2, r3 ...), words' continuation counts (kind words), counts behind spread words (kind pairs), held-out windows with their counts (kind held)."""
    top, levels = max(orders), _levels(orders)

    def run(table: pa.Table) -> pa.Table:
        m, training, hashes = _unpacked(table, top)
        width = BESIDE + 1 + len(hashes)
        whole = lambda c: np.where(c > BESIDE, hashes[np.maximum(c - BESIDE - 1, 0)], c) if len(hashes) else c.astype(np.int64)
        out: list[tuple] = []
        held = np.flatnonzero(~training)
        place = np.zeros(m.shape[1], np.int64)  # of a held-out window among them
        place[held] = np.arange(len(held))
        found = np.zeros((3 * len(levels) + 1, len(held)), np.int64)
        found[-1] = np.where(m[1, held] < hot, m[1, held], -1)
        live = np.arange(m.shape[1])
        x, nx = _ids(m[1])
        g, ng = _ids(x.astype(np.int64) * width + m[0])
        for n in range(2, top + 1):  # live: windows with a context of n - 1 words, x: their contexts, g: their n-grams
            tr = training[live]
            count, context = np.bincount(g[tr], minlength=ng), np.zeros(ng, np.int32)
            context[g] = x
            here = {("r", n): count}
            if n < top:
                longer = m[n, live] != NONE
                x2, nx2 = _ids(x[longer].astype(np.int64) * width + m[n, live[longer]])
                g2, ng2 = _ids(x2.astype(np.int64) * width + m[0, live[longer]])
                seen, inner = np.bincount(g2[tr[longer]], minlength=ng2) > 0, np.zeros(ng2, np.int32)
                inner[g2] = g[longer]
                here["k", n] = np.bincount(inner[seen], minlength=ng)
            at = ~tr
            if n == 2:
                token, behind = np.zeros(ng, np.int32), np.zeros(ng, np.int32)
                token[g], behind[g] = m[0], m[1]
                spread = behind < hot
                words, before = np.unique(token[(count > 0) & ~spread], return_counts=True)
                some = (count > 0) & spread
                pairs = np.array([whole(token[some]), behind[some], count[some], here["k", 2][some] if top > 2 else count[some]], np.int64)
                for kind, w, rest in (("words", whole(words), before.astype(np.int64)[None]), ("pairs", pairs[0], pairs[1:])):
                    to = _part(w, parts)
                    for p in np.unique(to):
                        out.append((int(p), kind, int((to == p).sum()), 0, w[to == p].tobytes(), rest[:, to == p].tobytes()))
                here, at = {level: np.where(spread, 0, c) for level, c in here.items()}, at & (m[1] >= hot)
            for level, c in here.items():
                if level in levels:
                    total, types = _sums(context, c, nx), np.bincount(context[c > 0], minlength=nx)
                    i = 3 * levels.index(level)
                    found[i : i + 3, place[live[at]]] = c[g[at]], total[x[at]], types[x[at]]
                    out.append((-1, f"{level[0]}{n}", int((c == 1).sum()), int((c == 2).sum()), None, None))
            if n < top:
                live, x, nx, g, ng = live[longer], x2, nx2, g2, ng2
        tokens = whole(m[0, held])
        to = _part(tokens, parts)
        for p in np.unique(to):
            own = to == p
            size, data = _packed(found[:, own])
            out.append((int(p), "held", int(own.sum()), size, data, tokens[own].tobytes()))
        return pa.Table.from_batches([_table(out)])

    return run


class _Singles:
    """Of a part of the tokens: words with their continuation counts, and (key, r, k) of the pairs of spread words and tokens."""

    def __init__(self, table: pa.Table, hot: int) -> None:
        read = lambda kind, k: [np.concatenate(x, -1) for x in zip(*((np.frombuffer(r["data"], np.int64), np.frombuffer(r["beside"], np.int64).reshape(k, r["n"])) for r in table.to_pylist() if r["kind"] == kind))] or [np.empty(0, np.int64), np.empty((k, 0), np.int64)]
        (tokens, rest), (words, (before,)) = read("pairs", 3), read("words", 1)
        self.hot, self.tokens = max(hot, 1), np.unique(tokens)
        self.keys, at = np.unique(self._keys(tokens, rest[0]), return_inverse=True)
        self.r, self.k = _sums(at, rest[1], len(self.keys)), _sums(at, rest[2], len(self.keys))
        words, before = np.concatenate((words, self.tokens[self.keys // self.hot])), np.concatenate((before, np.ones(len(self.keys), np.int64)))
        self.words, at = np.unique(words, return_inverse=True)
        self.counts = _sums(at, before, len(self.words))

    def _keys(self, tokens: np.ndarray, behind: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.tokens, tokens)
        return np.where(np.append(self.tokens, -1)[i] == tokens, i * self.hot + behind, -1)

    def of_words(self, tokens: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.words, tokens)
        return np.where(np.append(self.words, -1)[i] == tokens, np.append(self.counts, 0)[i], 0)

    def of_pairs(self, kind: str, tokens: np.ndarray, behind: np.ndarray) -> np.ndarray:
        keys = self._keys(tokens, behind)
        i = np.searchsorted(self.keys, keys)
        return np.where((keys >= 0) & (np.append(self.keys, -1)[i] == keys), np.append(getattr(self, kind), 0)[i], 0)


_TOTALS = "kind string, behind long, once long, twice long, total long, types long"


def _totals(levels: list[tuple[str, int]], hot: int) -> Callable:
    """(kind, behind, once, twice, total, types) of single words (k1, behind -1) and of the tokens behind each spread word (k2, r2)."""

    def run(table: pa.Table) -> pa.Table:
        s = _Singles(table, hot)
        rows = [("k1", -1, s.counts)]
        for kind, n in levels:
            if n == 2 and len(s.keys):
                rows += [(f"{kind}2", int(b), getattr(s, kind)[s.keys % s.hot == b]) for b in np.unique(s.keys % s.hot)]
        made = [(kind, b, int((c == 1).sum()), int((c == 2).sum()), int(c.sum()), int((c > 0).sum())) for kind, b, c in rows]
        return pa.table(dict(zip(("kind", "behind", "once", "twice", "total", "types"), map(list, zip(*made)))))

    return run


def _scored(orders: list[int], discounts: dict[str, float], totals: dict[tuple[str, int], tuple[int, int]], vocabulary: int, hot: int) -> Callable:
    """(order, targets, nll) of the held-out windows of a part of the tokens."""
    levels = _levels(orders)
    of = {kind: np.array([totals.get((kind, b), (0, 0)) for b in range(max(hot, 1))], np.int64) for kind in ("k2", "r2")}

    def run(table: pa.Table) -> pa.Table:
        singles = _Singles(table, hot)
        out = {n: [0, 0.0] for n in orders}
        for r in table.to_pylist():
            if r["kind"] != "held":
                continue
            tokens = np.frombuffer(r["beside"], np.int64)
            made = np.frombuffer(pa.decompress(r["data"], r["size"], codec="zstd", asbytes=True), np.int64).reshape(3 * len(levels) + 1, r["n"])
            found, spread = dict(zip(levels, made[:-1].reshape(len(levels), 3, r["n"]))), made[-1] >= 0
            behind = np.maximum(made[-1], 0)

            def mixed(p: np.ndarray, c: np.ndarray, total: np.ndarray, types: np.ndarray, d: float) -> np.ndarray:
                some = np.maximum(total, 1)
                return np.where(total > 0, np.maximum(c - d, 0.0) / some + d * types / some * p, p)

            def level(kind: str, n: int, p: np.ndarray) -> np.ndarray:
                c, total, types = found[kind, n]
                if n == 2:
                    t = of[f"{kind}2"][behind]
                    c, total, types = np.where(spread, singles.of_pairs(kind, tokens, behind), c), np.where(spread, t[:, 0], total), np.where(spread, t[:, 1], types)
                return mixed(p, c, total, types, discounts[f"{kind}{n}"])

            total, types = totals.get(("k1", -1), (0, 0))
            p = mixed(np.full(r["n"], 1.0 / vocabulary), singles.of_words(tokens), np.int64(total), np.int64(types), discounts["k1"])
            for n in range(2, max(orders) + 1):
                if n in orders:
                    out[n][0] += r["n"]
                    out[n][1] += float(-np.log(level("r", n, p)).sum())
                if n < max(orders):
                    p = level("k", n, p)
        return pa.table({"order": pa.array(list(out), pa.int32()), "targets": pa.array([x[0] for x in out.values()], pa.int64()), "nll": pa.array([x[1] for x in out.values()], pa.float64())})

    return run


def order_sweep(docs: DataFrame, orders: list[int], vocabulary: int, hot: int = 0) -> DataFrame:
    """(order, targets, nll): the held-out documents under models of several orders, two or more each.

    docs: (training: whether the model is fitted on it or held against it,
    low, beside: its words' codes), each document once; hot: how many of the
    most frequent words have their windows spread. A document's first token
    isn't scored. Windows behind one word, behind a spread one those behind
    two, are held by one task.
    """
    if min(orders) < 2:
        raise ValueError("orders start at 2")
    levels = _levels(orders)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.select("training", "low", "beside").mapInArrow(_windows(max(orders), parts, hot), _BLOCK)
    counted = written(blocks.groupBy("part").applyInArrow(_counted(orders, parts, hot), _BLOCK))
    found = counted.where("part = -1").groupBy("kind").agg(F.sum("n"), F.sum("size")).collect()
    single = counted.where("kind in ('words', 'pairs')").groupBy("part").applyInArrow(_totals(levels, hot), _TOTALS)
    single = single.groupBy("kind", "behind").agg(*(F.sum(c).alias(c) for c in ("once", "twice", "total", "types"))).collect()
    once, twice = Counter(), Counter()
    for kind, one, two in [*found, *((r.kind, r.once, r.twice) for r in single)]:
        once[kind] += one
        twice[kind] += two
    discounts = {kind: once[kind] / (once[kind] + 2 * twice[kind]) if once[kind] else 0.5 for kind in ("k1", *(f"{a}{n}" for a, n in levels))}
    totals = {(r.kind, r.behind): (r.total, r.types) for r in single}
    scores = counted.where("part >= 0").groupBy("part").applyInArrow(_scored(orders, discounts, totals, vocabulary, hot), "order int, targets long, nll double")
    at = lambda n, c: F.sum(F.when(F.col("order") == n, F.col(c)))
    return scores.agg(F.array(*(F.struct(F.lit(n).alias("order"), at(n, "targets").alias("targets"), at(n, "nll").alias("nll")) for n in orders)).alias("x")).select(F.inline("x"))
