"""Keeping the last delivered row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def utc_instant(c: Column | str) -> Column:
    """An ISO-8601 string in any usual spelling as a timestamp; null if it is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(F.trim(c))


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the first by the given orderings.

    Rows with a null key are dropped, since they name no record. Ties are
    broken by the hash of the whole row, so the result is the same in every
    run. One shuffle on the key; groups are revisions of one record and small.
    """
    plain = [f"`{c}`" for c in df.columns]
    w = Window.partitionBy(key).orderBy(*order, F.xxhash64(*plain))
    return df.where(F.col(key).isNotNull()).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")
