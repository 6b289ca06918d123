"""Binary shards of packed windows: magic, version, count, then fixed-size records."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The shard format.
MAGIC, VERSION, WIDTH = b"SKN1", 1, 256
RECORD = np.dtype([("input_ids", "<i4", (WIDTH,)), ("loss_mask", "u1", (WIDTH,)), ("segment_ids", "<i4", (WIDTH,)), ("byte_count", "<u4")])
HEAD = struct.Struct("<4sII")
COLUMNS = "window long, input_ids array<int>, loss_mask array<int>, segment_ids array<int>, byte_count long"


def encode(batch: pa.RecordBatch) -> bytes:
    """A shard of all windows of the batch, in their order."""
    rows = np.zeros(batch.num_rows, RECORD)
    for c in ("input_ids", "loss_mask", "segment_ids"):
        rows[c] = np.array(batch[c].to_pylist(), dtype=np.int64).reshape(-1, WIDTH)
    rows["byte_count"] = batch["byte_count"].to_numpy()
    return HEAD.pack(MAGIC, VERSION, len(rows)) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The records of a shard; raises for another format or a wrong size."""
    if len(data) < HEAD.size:
        raise ValueError("not a shard: too short")
    magic, version, count = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a shard of this format")
    if len(data) != HEAD.size + count * RECORD.itemsize:
        raise ValueError("a shard's size differs from what its head says")
    return np.frombuffer(data, RECORD, count, HEAD.size)


def shard_rows(windows: DataFrame, per_shard: int = 20_000) -> DataFrame:
    """(shard, windows, bytes, sha256, data): windows in shards of per_shard, each put together in one group of that size."""

    def build(table: pa.Table) -> pa.Table:
        batch = table.sort_by("window").combine_chunks().to_batches()[0]
        return pa.table({"shard": table["shard"][:1], "windows": pa.array([batch.num_rows], pa.int64()), "bytes": pa.array([int(np.sum(batch["byte_count"].to_numpy()))], pa.int64()), "data": pa.array([encode(batch)], pa.binary())})

    rows = windows.select(F.floor(F.col("window") / per_shard).alias("shard"), "window", "input_ids", "loss_mask", "segment_ids", F.col("byte_count").cast("long").alias("byte_count"))
    return rows.groupBy("shard").applyInArrow(build, "shard long, windows long, bytes long, data binary").withColumn("sha256", F.sha2("data", 256))


def write_folder(windows: DataFrame, folder: str, per_shard: int = 20_000) -> DataFrame:
    """Write shards as files of a folder that all executors see; returns their manifest (shard, windows, bytes, sha256, path)."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for n, data in zip(batch["shard"].to_pylist(), batch["data"].to_pylist()):
                path = f"{folder}/shard-{n:05d}.bin"
                with open(f"{path}.{os.getpid()}.part", "wb") as f:
                    f.write(data)
                os.replace(f"{path}.{os.getpid()}.part", path)  # a task that runs twice leaves one whole file
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch["shard"], batch["windows"], batch["bytes"], batch["sha256"], pa.array(paths)], names=["shard", "windows", "bytes", "sha256", "path"])

    rows = shard_rows(windows, per_shard).select("shard", "windows", "bytes", "sha256", "data")
    made = rows.mapInArrow(put, "shard long, windows long, bytes long, sha256 string, path string").collect()
    return windows.sparkSession.createDataFrame(made, "shard long, windows long, bytes long, sha256 string, path string")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All windows of a folder's shards (path and the shard columns); window counts within its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                rows = decode(data)
                lists = [pa.array([list(map(int, r)) for r in rows[c]], pa.list_(pa.int32())) for c in ("input_ids", "loss_mask", "segment_ids")]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(np.arange(len(rows))), *lists, pa.array(rows["byte_count"].astype(np.int64))], names=["path", "window", "input_ids", "loss_mask", "segment_ids", "byte_count"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "content")
    return files.mapInArrow(run, "path string, " + COLUMNS)
