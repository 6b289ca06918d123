"""Acceptance rules over texts, the reasons they give, and counts of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X


@dataclass(frozen=True)
class Thresholds:
    least_chars: int = 200
    least_paragraphs: int = 2
    least_alpha: float = 0.65
    most_markup: float = 0.02
    most_repeated: float = 0.35
    least_language: float = 0.90
    least_language_words: int = 20
    full_rate: float = 0.35


def assess(df: DataFrame, text: str = "text", t: Thresholds = Thresholds(), extra: list[Column] | None = None) -> DataFrame:
    """df with language_score, quality_score, reasons (in fixed order) and accepted.

    Null text counts as empty. extra: further reasons, a string or null each,
    put after those of the text (allowlist, cutoff). The score of a rejected
    text is 0.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("language_score", X.language_score(c, t.least_language_words, t.full_rate))
    rules = [
        F.when(F.length(c) < t.least_chars, "too_short"),
        F.when(F.size(X.blocks(c)) < t.least_paragraphs, "too_few_paragraphs"),
        F.when(X.alpha_ratio(c) < t.least_alpha, "low_alpha_ratio"),
        F.when(X.markup_ratio(c) > t.most_markup, "markup_contamination"),
        F.when(X.repeated_line_ratio(c) > t.most_repeated, "repeated_lines"),
        F.when(F.col("language_score") < t.least_language, "low_language_score"),
        *(extra or []),
    ]
    out = out.withColumn("reasons", F.array_compact(F.array(*rules))).withColumn("accepted", F.size("reasons") == 0)
    return out.withColumn("quality_score", F.when(F.col("accepted"), X.quality_score(c, F.col("language_score"))).otherwise(0.0))


def reason_counts(assessed: DataFrame) -> DataFrame:
    """(reason, documents) over all rows; a document counts for each of its reasons."""
    return assessed.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("documents"))


def funnel(df: DataFrame, stages: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(stage, position, documents, bytes): for every stage (kept, text) the rows kept and their UTF-8 bytes, in one pass."""
    sums = []
    for name, (kept, text) in stages.items():
        k = F.coalesce(kept, F.lit(False))
        sums += [F.count_if(k).alias(f"{name}__n"), F.coalesce(F.sum(F.when(k, F.octet_length(text))), F.lit(0)).cast("long").alias(f"{name}__b")]
    one = df.agg(*sums)
    rows = F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(i).cast("long").alias("position"), F.col(f"{n}__n").alias("documents"), F.col(f"{n}__b").alias("bytes")) for i, n in enumerate(stages)))
    return one.select(F.inline(rows))


def calibration(assessed: DataFrame, should_accept: Column) -> DataFrame:
    """(labelled, false_rejects, missed_rejects): the rules against given verdicts; null verdicts aren't counted."""
    return assessed.agg(
        F.count(should_accept).alias("labelled"),
        F.count_if(should_accept & ~F.col("accepted")).alias("false_rejects"),
        F.count_if(~should_accept & F.col("accepted")).alias("missed_rejects"),
    )


def within_cutoff(published: Column, cutoff: str, null_allowed: Column | None = None) -> Column:
    """Whether an ISO time is at or before the cutoff; null or no time only where null_allowed."""
    at = F.try_to_timestamp(F.trim(published))
    return F.coalesce(at <= F.to_timestamp(F.lit(cutoff)), null_allowed if null_allowed is not None else F.lit(False))


def checked_source(df: DataFrame, approved: DataFrame, source: str = "source") -> DataFrame:
    """df with approved: of the small dimension (source, approved); a source that isn't in it makes the query fail."""
    dim = approved.select(F.col("source").alias("__s"), "approved").distinct()
    return df.join(dim, F.col(source) == F.col("__s"), "left").drop("__s").withColumn("approved", F.coalesce("approved", F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(F.col(source), F.lit("null")))).cast("boolean")))


def first_matching_pattern(value: Column, patterns: list[str]) -> Column:
    """The first of the case-insensitive patterns that is found in the value; null if none is."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        out = F.when(value.rlike(f"(?i){p}"), p).otherwise(out)
    return out
