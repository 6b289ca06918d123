"""The records of the manifest table: the latest delivery of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.classes import Corpus, corpus_of
from skein.operators.latest import latest_per_key, utc_instant
from skein.sources.tables import table


def records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """document_id and the columns of each document's row with the latest retrieved_at."""
    rows = table(spark, folder, "astronomy_sample").select("document_id", "retrieved_at", *columns)
    return latest_per_key(rows, "document_id", utc_instant("retrieved_at").desc_nulls_last()).drop("retrieved_at")


def split_name(c: str = "split") -> F.Column:
    """The split as compared: trimmed and lower-cased."""
    return F.lower(F.trim(F.col(c)))


def corpus(spark: SparkSession, folder: str, least: int = 1, **extra: F.Column) -> Corpus:
    """The same records with their texts apart; ties of retrieved_at go by the hash of the kept columns."""
    return corpus_of(table(spark, folder, "astronomy_sample"), "document_id", "text", utc_instant("retrieved_at"), extra=extra, least=least)
