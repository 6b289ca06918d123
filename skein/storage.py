"""Written intermediate tables, shared by all executors.

An iterative operator, or one whose intermediate result is read several
times, writes it as Parquet below the shared checkpoint folder and reads it
back. That cuts lineage, survives the loss of executors and gives the
optimiser the table's true size. Tables lie in one folder an application,
which is deleted when the application ends; `scope` deletes earlier.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_ours: set[str] = set()
_scopes: list[list[tuple[str, str | None]]] = []
#: Spark refuses more buckets.
MOST_BUCKETS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only in local mode, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the application may be gone already
        _delete(spark, folder)


def _place(spark: SparkSession, name: str | None = None) -> str:
    folder = f"{shared_folder(spark)}/skein-{spark.sparkContext.applicationId}"
    if folder not in _ours:
        _ours.add(folder)
        atexit.register(_clean, spark, folder)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((path, name))
    return path


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables written within it: for callers that act on a result before they leave."""
    _scopes.append([])
    try:
        yield
    finally:
        for path, name in _scopes.pop():
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            _delete(spark, path)


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read from a table in the shared folder."""
    spark = df.sparkSession
    path = _place(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df, written once in buckets of the key, as many as there are shuffle partitions.

    Joins and groupings on the key read the buckets as they lie: only the
    other, narrower side of a join is shuffled. Best made from rows that are
    partitioned by the key already, as then each bucket is one file.
    """
    spark = df.sparkSession
    name = f"skein_{uuid.uuid4().hex}"
    n = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(n, key).sortBy(key).option("path", _place(spark, name)).saveAsTable(name)
    return spark.table(name)
