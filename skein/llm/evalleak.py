"""Evaluation texts inside training texts, with one Aho-Corasick automaton.

Texts and items are compared in normal form: NFKC, lower case, letters and
digits only. The automaton holds every item's blocks of half the least length,
side by side, so that any run of that length in common contains one of them;
each text is scanned once, and a block found is extended on both sides to the
longest run in common. Items between SHORTEST and the least length are
patterns as a whole. Positions are mapped back to the original text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import written

LEAST, SHORTEST = 48, 24
#: Items of one automaton; more are scanned for in several passes, so that what executors get stays bounded.
BLOCK_ITEMS = 20_000
_built: dict = {}


def normal(text: str) -> str:
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).lower()))


def origins(text: str) -> list[int]:
    """For every character of normal(text), the position in text that it comes from."""
    out: list[int] = []
    at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and (unicodedata.category(text[end])[0] == "M" or "ᅠ" <= text[end] <= "ᇿ"):
            end += 1
        out += [at] * len(normal(text[at:end]))
        at = end
    return out


def place_of(text: str, at: int) -> int:
    """The position in text of the character at of normal(text), for texts that don't fall into parts with forms of their own."""
    lo, hi = 0, len(text)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if len(normal(text[:mid])) <= at else (lo, mid)
    return lo


def automaton(items: list[tuple[int, str]], least: int = LEAST):
    import ahocorasick

    made, places = ahocorasick.Automaton(), {}
    step = least // 2
    for n, (_, text) in enumerate(items):
        starts = range(0, len(text) - step + 1, step) if len(text) >= least else [0]
        for s in starts:
            block = text[s : s + step] if len(text) >= least else text
            places.setdefault(block, []).append((n, s))
    for block, at in places.items():
        made.add_word(block, (len(block), at))
    made.make_automaton()
    return made


def leaks_in(text: str, items: list[tuple[int, str]], made, least: int = LEAST) -> dict[int, tuple[int, int, int]]:
    """Item id -> (start, end, length in normal form) of the longest run, for all items with a case in the text."""
    form = normal(text)
    best: dict[int, tuple[int, int]] = {}
    reached: dict[tuple[int, int], int] = {}
    for last, (size, at) in made.iter(form):
        begin = last - size + 1
        for n, s in at:
            if reached.get((n, begin - s), 0) > begin:
                continue  # inside a run already measured
            item = items[n][1]
            lo, hi = 0, size
            while begin + hi < len(form) and s + hi < len(item) and form[begin + hi] == item[s + hi]:
                hi += 1
            while begin - lo > 0 and s - lo > 0 and form[begin - lo - 1] == item[s - lo - 1]:
                lo += 1
            reached[n, begin - s] = begin + hi
            if lo + hi >= min(least, len(item)) and lo + hi > best.get(n, (0, 0))[1]:
                best[n] = (begin - lo, lo + hi)
    if not best:
        return {}
    place = origins(text)
    at = place.__getitem__ if len(place) == len(form) else lambda i: place_of(text, i)
    return {items[n][0]: (at(b), at(b + k - 1) + 1, k) for n, (b, k) in best.items()}


def _scan(shared, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        if not items:
            return
        if _built.get("items") is not items or _built.get("least") != least:
            _built.update(items=items, least=least, made=automaton(items, least))  # the items stay alive as long as their automaton
        made = _built["made"]
        for batch in batches:
            out = []
            for i, (doc, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())):
                out += [(doc, item, *where) for item, where in leaks_in(text, items, made, least).items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "start", "end", "run_chars"])

    return run


def leaked_passages(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, start, end, run_chars, item_share), one row per document and item with a case.

    A case is a run of `least` characters of the item's normal form in the
    text's, or the whole item if it has `shortest` to `least` - 1. start and
    end are code points of the original text around the longest run, whose
    length in normal form is run_chars, item_share its share of the item.
    Null texts and ids have no cases, nor shorter items; items of equal text
    are cases each; repeated rows are reported once.
    """
    spark = docs.sparkSession
    form = F.pandas_udf(lambda s: s.map(normal), "string")
    forms = items.select(F.col(item).cast("long").alias("item_id"), form(F.coalesce(F.col(text), F.lit(""))).alias("form")).where(F.col("item_id").isNotNull() & (F.length("form") >= shortest)).distinct()
    forms = written(forms)
    count = forms.count()
    passes = max(1, -(-count // BLOCK_ITEMS))
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, start long, end long, run_chars long"
    out = None
    for n in range(passes):
        block = sorted((r.item_id, r.form) for r in forms.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == n).collect())
        part = rows.mapInArrow(_scan(spark.sparkContext.broadcast(block), least), schema)
        out = part if out is None else out.union(part)
    lengths = forms.groupBy("item_id").agg(F.max(F.length("form")).alias("n"))
    return out.distinct().join(lengths, "item_id").select("doc_id", "item_id", "start", "end", "run_chars", F.round(F.col("run_chars") / F.col("n"), 6).alias("item_share"))
