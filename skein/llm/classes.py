"""Records and their texts, held apart: texts are moved once, by the hash of the text.

Every search works on the classes of equal texts; results name all members.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.latest import latest_per_key
from skein.storage import bucketed, written


@dataclass
class Corpus:
    """members: (id, class, chars, extra columns), each id once; texts: (class, text), each class once."""

    members: DataFrame
    texts: DataFrame


def corpus_of(df: DataFrame, id: str, text: str, *order: Column, extra: dict[str, Column] | None = None, least: int = 1) -> Corpus:
    """The records of delivered rows and their distinct texts of `least` characters or more.

    Of several rows with one id, the first by `order` is the record; without
    an order, or among ties, a fixed one. Only ids, hashes and the extra
    columns take part in that choice, so whole texts are shuffled once, by
    class, with copies dropped before the shuffle, and kept in buckets of the
    class, so that no later join moves them all again. Rows with null id are
    dropped; null or shorter texts have no class and are in no pair. The class
    is the 64-bit hash of the text; a second hash makes the query fail, rather
    than merge, if two different texts ever had the same.
    """
    rows = df.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"), *(c.alias(f"__o{i}") for i, c in enumerate(order)), *(c.alias(n) for n, c in (extra or {}).items()))
    usable = F.length("text") >= least
    rows = rows.withColumn("class", F.when(usable, F.xxhash64(F.lit(17012), "text")))
    narrow = rows.withColumns({"h2": F.when(usable, F.xxhash64("text")), "chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")}).drop("text")
    members = written(latest_per_key(narrow, "id", *(F.col(f"__o{i}").desc_nulls_last() for i in range(len(order)))).drop(*(f"__o{i}" for i in range(len(order)))))
    clash = F.when(F.min("h2") != F.max("h2"), F.raise_error(F.lit("two texts with one hash"))).otherwise(F.lit(True))
    classes = members.where("class is not null").groupBy("class").agg(clash.alias("one")).where("one").select("class")
    texts = rows.where("class is not null").select("class", "text").dropDuplicates(["class"]).join(classes, "class", "left_semi")
    return Corpus(members.drop("h2"), bucketed(texts, "class"))


def expand_pairs(pairs: DataFrame, members: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(a, b) of member ids, a < b, each once.

    pairs: (ka, kb) of class keys; members: (class, id) with each id once;
    within: the members of those classes whose own members pair up as well.
    All joins are on the class key; a class with very many members is split
    by the adaptive skew join.
    """
    m = members.select("class", "id")
    across = (
        pairs.select("ka", "kb")
        .distinct()
        .join(m.select(F.col("class").alias("ka"), F.col("id").alias("x")), "ka")
        .join(m.select(F.col("class").alias("kb"), F.col("id").alias("y")), "kb")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .where("a <> b")
    )
    if within is None:
        return across
    l, r = within.select("class", F.col("id").alias("a")), within.select("class", F.col("id").alias("b"))
    return across.union(l.join(r, "class").where("a < b").select("a", "b"))
