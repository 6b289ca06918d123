"""Records that keep arriving: each delivery once, and counts per window with late rows dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.operators.latest import utc_instant


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """A stream over the Parquet files of a folder; null and malformed times become null."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def delivered_once(stream: DataFrame, keys: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """Rows whose keys weren't seen within the delay; state older than the watermark is let go."""
    return stream.withColumn("__at", utc_instant(F.col(at).cast("string"))).withWatermark("__at", delay).dropDuplicatesWithinWatermark(keys).drop("__at")


def windowed_counts(stream: DataFrame, at: str, by: list[str], window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(window_start, by, n) for tumbling windows; rows later than the delay are left out once their window is closed."""
    rows = stream.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay)
    return rows.groupBy(F.window("__at", window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Process all files there are, exactly once across restarts, into a Parquet folder; returns what it holds."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)
