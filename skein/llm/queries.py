"""The pN_ queries over the project's tables, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import boilerplate, evalleak, groupsplit, mixing, neardup, quality, sentences, spans, splitleak
from skein.llm.records import corpus, records, split_name
from skein.operators.latest import latest_per_key, utc_instant
from skein.sources.tables import table
from skein.storage import written

S, D = SparkSession, DataFrame


def _pairs(df: D) -> D:
    return df.select(F.col("a").alias("document_id_a"), F.col("b").alias("document_id_b"))


def p1_found(spark: S, sf: str) -> D:
    return _pairs(spans.sharing_pairs(corpus(spark, sf, least=160)))


def p1_shared_coverage(spark: S, sf: str) -> D:
    return spans.shared_coverage(corpus(spark, sf)).withColumnRenamed("id", "document_id")


def _statistics(spark: S, sf: str) -> D:
    """Statistics of the records: computed on every delivered row, of which the latest is then taken without its text."""
    words = quality.word_lists(table(spark, sf, "common_words"))
    rows = table(spark, sf, "astronomy_sample").select("text", F.struct("document_id", utc_instant("retrieved_at").alias("at")).alias("key"))
    stats = quality.text_statistics(rows, "key", "text", words)
    return latest_per_key(stats.select("id.document_id", "id.at", *(c for c in stats.columns if c != "id")), "document_id", F.col("at").desc_nulls_last()).drop("at")


def p2_found(spark: S, sf: str) -> D:
    return quality.not_prose(_statistics(spark, sf)).select("document_id")


def p2_statistics(spark: S, sf: str) -> D:
    stats = written(_statistics(spark, sf))
    out = quality.percentiles_and_tails(stats, quality.statistic_sketches(stats))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith(("p_", "z_")) or c in quality.STATS[1:]}).withColumn("tails", F.array_join("tails", ","))


def _lines(spark: S, sf: str) -> D:
    rows = boilerplate.line_rows(table(spark, sf, "astronomy_sample"), "document_id", "text", "source", F.col("published_at"), keep={"at": utc_instant("retrieved_at")})
    return written(latest_per_key(rows, "id", F.col("at").desc_nulls_last()).drop("at"))


def _repeated(spark: S, sf: str, rows: D) -> D:
    """The repeated lines of the records, near copies collapsed before lines are counted."""
    groups = neardup.near_duplicate_groups(corpus(spark, sf), 0.8).select("id", F.col("group_id").alias("cluster"))
    return written(boilerplate.repeated_lines(written(boilerplate.clustered(rows, groups))))


def p3_found(spark: S, sf: str) -> D:
    rows = _lines(spark, sf)
    return boilerplate.line_occurrences(rows, _repeated(spark, sf, rows)).withColumnRenamed("id", "document_id")


def p3_repeated_lines(spark: S, sf: str) -> D:
    rows = _lines(spark, sf)
    found = _repeated(spark, sf, rows)
    return boilerplate.named_lines(found, rows, records(spark, sf, "text"), "document_id", "text").drop("line", "n_clusters")


def p3_cleaned(spark: S, sf: str) -> D:
    found = _repeated(spark, sf, _lines(spark, sf))
    return boilerplate.without_lines(records(spark, sf, "source", "text"), found, "document_id", "text", "source").withColumnRenamed("id", "document_id")


def p4_found(spark: S, sf: str) -> D:
    return _pairs(neardup.near_duplicate_pairs(corpus(spark, sf), 0.7))


def p4_groups(spark: S, sf: str) -> D:
    return neardup.near_duplicate_groups(corpus(spark, sf), 0.8).withColumnRenamed("id", "document_id")


def p5_found(spark: S, sf: str) -> D:
    pairs = splitleak.leaking_pairs(corpus(spark, sf, split=split_name()), 0.7)
    return pairs.select(F.least("eval_id", "train_id").alias("document_id_a"), F.greatest("eval_id", "train_id").alias("document_id_b"))


def p5_leak_report(spark: S, sf: str) -> D:
    c = corpus(spark, sf, split=split_name(), source=F.col("source"))
    return splitleak.leak_report(splitleak.leaking_pairs(c, 0.7), c.members.select("id", "split", "source"))


def p5_coverage(spark: S, sf: str) -> D:
    """Every evaluation record that leaks: its training partners, the greatest share of its set in one, and the most words aligned with one."""
    c = corpus(spark, sf, split=split_name(), source=F.col("source"))
    per = splitleak.leaking_pairs(c, 0.7).groupBy(F.col("eval_id").alias("id")).agg(F.count("*").alias("pairs"), F.max("share").alias("best_share"), F.max("aligned_words").alias("aligned_words"), F.max("eval_words").alias("words"))
    return c.members.select(F.col("id").alias("document_id"), "split", "source").join(per.withColumnRenamed("id", "document_id"), "document_id")


def _components(spark: S, sf: str) -> D:
    rows = records(spark, sf, "source", "source_record_id", "dedup_cluster_id", "split")
    rows = written(rows.select("document_id", "source", "source_record_id", F.nullif(F.lower(F.regexp_extract("dedup_cluster_id", r"(?i)(?<![0-9a-f])([0-9a-f]{16})(?![0-9a-f])", 1)), F.lit("")).alias("cluster"), split_name().alias("split")))
    same = F.when(F.col("source").isNotNull() & F.col("source_record_id").isNotNull(), F.struct("source", "source_record_id"))
    return groupsplit.updated(rows, "document_id", [F.col("cluster"), same], "split").records


def p6_found(spark: S, sf: str) -> D:
    return groupsplit.torn_groups(_components(spark, sf)).select(F.col("component").alias("group_id"))


def p6_assignment(spark: S, sf: str) -> D:
    return groupsplit.assign_splits(written(_components(spark, sf))).withColumnsRenamed({"id": "document_id", "component": "group_id"})


def _leaks(spark: S, sf: str) -> D:
    return evalleak.leaked_passages(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_found(spark: S, sf: str) -> D:
    return _leaks(spark, sf).select("doc_id", "item_id")


def p7_passages(spark: S, sf: str) -> D:
    return _leaks(spark, sf)


def p8_mix(spark: S, sf: str) -> D:
    chosen, _ = mixing.mixed(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    return chosen.withColumnRenamed("id", "doc_id")


def p8_shares(spark: S, sf: str) -> D:
    return mixing.mixed(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p9_found(spark: S, sf: str) -> D:
    return sentences.sentence_units(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_shared_coverage, p2_found, p2_statistics, p3_found, p3_repeated_lines, p3_cleaned, p4_found, p4_groups, p5_found, p5_leak_report, p5_coverage, p6_found, p6_assignment, p7_found, p7_passages, p8_mix, p8_shares, p9_found)}
