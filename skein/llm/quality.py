"""Per-document text statistics, quantile sketches of them per language, and tails.

All statistics are built-in expressions over the whole text, so the scan,
the statistics and the partial sketches are one pass without a shuffle of
texts. Sketches are KLL: each task builds its own, they are merged per
language, and every value's percentile is read from the merged one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space, as a character class body for Java and RE2 alike.
WHITE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Marks that end a line of prose.
LINE_ENDS = ".!?…\"”’)»"
STATS = ("n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_share")
#: Most words of the common-word table that are put into the plan; the table is fixed and has 164.
MOST_COMMON_WORDS = 10_000


def word_lists(common: DataFrame) -> dict[str, list[str]]:
    """Words per language of a small fixed table (lang, word); raises if it isn't small."""
    rows = common.where("word is not null").select(F.coalesce("lang", F.lit("")).alias("lang"), "word").distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError("the table of common words is too large to be one of common words")
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r.lang, []).append(r.word)
    return out


def text_statistics(df: DataFrame, id: str, text: str, common: dict[str, list[str]]) -> DataFrame:
    """(id, blank, n_chars, the five STATS, lang) of every row.

    Words are the maximal runs of non-whitespace. Null and blank texts have
    n_words 0 and null in the other statistics. lang is the language whose
    common words occur most often, ties to the first by name, und without any.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    ended = F.filter("lines", lambda x: F.substring(x, -1, 1).isin(*LINE_ENDS))
    every = sorted({w for ws in common.values() for w in ws})
    base = df.select(F.col(id).alias("id"), F.length(t).cast("long").alias("n_chars"), F.regexp_replace(t, r"(?U)^\s+|\s+\z", "").alias("t"))
    # the letters of all words at once; words without letters leave nothing behind
    letters = F.split(F.regexp_replace(F.lower("t"), r"(?U)[^\p{L}\s]+", ""), r"(?U)\s+")
    base = base.select(
        "id",
        "n_chars",
        F.when(F.col("t") != "", F.split("t", r"(?U)\s+")).alias("words"),
        F.length(F.regexp_replace("t", r"(?U)[\s\p{L}\p{N}]+", "")).alias("symbols"),
        # stripped lines: a newline takes the whitespace around it along, blank lines included
        F.split("t", r"(?U)\s*\n\s*").alias("lines"),
        (F.filter(letters, lambda w: w.isin(*every)) if every else F.array().cast("array<string>")).alias("hits"),
    )
    base = base.select("id", "n_chars", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"), F.length(F.array_join("words", "")).alias("visible"), "symbols", "lines", "hits")
    base = base.withColumns({"n_lines": F.size("lines"), "n_ended": F.size(ended)})
    among = lambda ws: F.size(F.filter("hits", lambda w: w.isin(*ws)))
    by_lang = [F.struct((-among(ws)).alias("n"), F.lit(lang).alias("lang")) for lang, ws in common.items()]
    best = F.array_min(F.array(*by_lang)) if by_lang else F.struct(F.lit(0).alias("n"), F.lit("und").alias("lang"))
    share = lambda a, b: F.when(b > 0, a / b)
    return base.withColumn("best", best).select(
        "id",
        (F.col("n_words") == 0).alias("blank"),
        "n_chars",
        "n_words",
        share(F.col("visible"), F.col("n_words")).alias("mean_word_length"),
        share(F.col("symbols"), F.col("visible")).alias("symbol_ratio"),
        share(F.col("n_ended"), F.col("n_lines")).alias("line_end_share"),
        share(F.size("hits"), F.col("n_words")).alias("common_share"),
        F.when(F.col("best.n") < 0, F.col("best.lang")).otherwise(F.lit("und")).alias("lang"),
    )


def not_prose(stats: DataFrame) -> DataFrame:
    """The rows with text for which at least two of the five fixed rules hold."""
    rules = [
        F.col("n_words") < 30,
        (F.col("mean_word_length") < 3.5) | (F.col("mean_word_length") > 8.0),
        F.col("symbol_ratio") > 0.12,
        F.col("line_end_share") < 0.25,
        F.col("common_share") < 0.15,
    ]
    return stats.where(~F.col("blank")).where(sum((r.cast("int") for r in rules), F.lit(0)) >= 2)


def statistic_sketches(stats: DataFrame, k: int = 400) -> DataFrame:
    """(lang, n, one KLL sketch for each of STATS) over all rows with text; one row a language."""
    return stats.where(~F.col("blank")).groupBy("lang").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(F.col(s).cast("double"), k).alias(f"sk_{s}") for s in STATS))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """Sketch tables of separate runs as one, without their texts."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("lang").agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(f"sk_{s}").alias(f"sk_{s}") for s in STATS))


#: Ranks at which the merged sketches are read.
GRID = [i / 200 for i in range(201)]


def percentiles_and_tails(stats: DataFrame, sketches: DataFrame, tail: float = 0.02, least_z: float = 3.0) -> DataFrame:
    """stats with, for every statistic, p_ (its percentile within the language), z_ (robust z-score), and tails.

    A percentile is the share of the sketch's 201 grid quantiles not above
    the value; a z-score is the distance from the median in units of the
    quartile range / 1.349, null where that is 0. tails has the statistics in
    the outer `tail` on either side that are also at least `least_z` from the
    median, or off a median that all quartiles share. Rows without text have
    nulls and no tails. There is one row of sketches a language, of a bounded
    size each.
    """
    ranks = F.array(*(F.lit(g) for g in GRID))
    grids = sketches.select("lang", *(F.kll_sketch_get_quantile_double(f"sk_{s}", ranks).alias(f"g_{s}") for s in STATS))
    joined = stats.join(grids, "lang", "left")
    n = len(GRID)
    value = lambda s: F.when(~F.col("blank"), F.col(s).cast("double"))
    below = lambda s: F.size(F.filter(f"g_{s}", lambda q: q <= value(s)))
    out = joined.withColumns({f"p_{s}": F.when(value(s).isNotNull(), below(s) / n) for s in STATS})
    q = lambda s, at: F.element_at(f"g_{s}", round(at * (n - 1)) + 1)
    out = out.withColumns({f"z_{s}": (value(s) - q(s, 0.5)) / F.nullif((q(s, 0.75) - q(s, 0.25)) / 1.349, F.lit(0.0)) for s in STATS})
    far = lambda s: F.coalesce(F.abs(f"z_{s}") >= least_z, value(s) != q(s, 0.5))
    outer = lambda s: (F.col(f"p_{s}") <= tail) | (F.col(f"p_{s}") >= 1 - tail)
    flags = F.array_compact(F.array(*(F.when(outer(s) & far(s), F.lit(s)) for s in STATS)))
    return out.withColumn("tails", flags).drop(*(f"g_{s}" for s in STATS))
