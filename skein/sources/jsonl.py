"""JSON lines in and out."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_strict(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a malformed one makes the query fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON lines; malformed ones are skipped, a file that doesn't exist has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_rows(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with keys in alphabetical order; mode append adds to what is there."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def write_by_split(df: DataFrame, root: str, sealed_root: str, split: str = "split") -> None:
    """Every split in a folder of its own below root; test below sealed_root instead, never below root."""
    if os.path.normpath(root) == os.path.normpath(sealed_root):
        raise ValueError("the sealed folder must be another one")
    df.where(F.col(split) != "test").write.partitionBy(split).json(root)
    df.where(F.col(split) == "test").write.partitionBy(split).json(sealed_root)


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key isn't done yet: what a resumed run has to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
