"""Token sequences packed into fixed windows, by a prefix sum that no single task computes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.storage import written

WIDTH = 256


def byte_shares(tokens: Column, utf8_bytes: Column) -> Column:
    """The document's bytes over its tokens: equal parts, the first ones with the remainder; no tokens, no shares."""
    n = F.size(tokens)
    base, more = F.floor(utf8_bytes / n), utf8_bytes % n
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (base + F.when(i < more, 1).otherwise(0)).cast("long"))).otherwise(F.array().cast("array<long>"))


def offsets(df: DataFrame, key: str, size: Column, ranges: int | None = None) -> DataFrame:
    """df with `offset`: the sum of size over all rows before it in the order of the key, which is of any kind that can be ordered.

    Rows are spread over ranges of the key's sampled order, as many as there
    are shuffle partitions or as `ranges` says if that is more; the ranges'
    sums are added up first, then each range's own rows.
    """
    rows = df.withColumn("__n", size.cast("long"))
    parts = max(ranges or 0, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, key).withColumn("__p", F.spark_partition_id())
    kept = written(ranged)
    per = kept.groupBy("__p").agg(F.sum("__n").alias("__s"))
    before = per.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__b"))
    inner = Window.partitionBy("__p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return kept.join(before, "__p").withColumn("offset", F.col("__b") + F.sum("__n").over(inner) - F.col("__n")).drop("__p", "__n", "__b")


def pack(df: DataFrame, id: str, tokens: str, utf8_bytes: str, eos: int, pad: int, width: int = WIDTH) -> DataFrame:
    """Windows (window, input_ids, loss_mask, segment_ids, byte_count, document_ids) of `width` tokens.

    Documents follow each other in the order of their ids, each ended by eos,
    which has no bytes. A document without tokens is its eos alone, and its
    bytes are lost. The last window is filled up with pads. The mask is 0 at a
    window's first place and at pads; segments number the documents within a
    window from 0, pads count -1, -2 and on. A token's place follows from its
    document's offset, so windows are put together by one grouping.
    """
    rows = df.select(F.col(id).alias("id"), F.coalesce(F.col(tokens), F.array().cast("array<int>")).alias("tokens"), F.coalesce(F.col(utf8_bytes), F.lit(0)).cast("long").alias("bytes"))
    placed = offsets(rows, "id", F.size("tokens") + 1)
    # a document's share of each window it touches, as slices: rows move by window, not by token
    full = F.concat("tokens", F.array(F.lit(eos)))
    shares = F.concat(byte_shares(F.col("tokens"), F.col("bytes")), F.array(F.lit(0).cast("long")))
    n = F.size(full)
    spread = placed.select("id", "offset", full.alias("t"), shares.alias("s"), F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + n - 1) / width))).alias("window"))
    lo = F.greatest(F.lit(0).cast("long"), F.col("window") * width - F.col("offset"))
    hi = F.least(F.size("t").cast("long"), (F.col("window") + 1) * width - F.col("offset"))
    part = spread.select(
        "window",
        (F.col("offset") + lo - F.col("window") * width).alias("at"),
        "id",
        F.slice("t", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("t"),
        F.aggregate(F.slice("s", (lo + 1).cast("int"), (hi - lo).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x).alias("b"),
    )
    grouped = part.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("at", "id", "t"))).alias("parts"), F.sum("b").alias("byte_count"))  # at most `width` parts a window
    ids = F.flatten(F.transform("parts", lambda p: p["t"]))
    seg = F.flatten(F.transform("parts", lambda p, i: F.array_repeat(i, F.size(p["t"]))))
    fill = F.lit(width) - F.size(ids)
    pads = F.when(fill > 0, F.transform(F.sequence(F.lit(1), F.greatest(fill, F.lit(1))), lambda i: -i)).otherwise(F.array().cast("array<int>"))
    out = grouped.withColumns({"input_ids": F.concat(ids, F.array_repeat(F.lit(pad), fill)), "segment_ids": F.concat(seg, pads), "document_ids": F.transform("parts", lambda p: p["id"])})
    return out.select("window", "input_ids", F.transform("input_ids", lambda t, i: F.when((i == 0) | (t == pad), 0).otherwise(1)).alias("loss_mask"), "segment_ids", "byte_count", "document_ids")


def token_stream(windows: DataFrame) -> DataFrame:
    """(window, at, token, segment) of all tokens but pads."""
    z = F.posexplode(F.arrays_zip(F.col("input_ids").alias("token"), F.col("segment_ids").alias("segment"))).alias("at", "z")
    return windows.select("window", z).where("z.segment >= 0").select("window", "at", "z.token", "z.segment")


def overlapping_chunks(df: DataFrame, id: str, tokens: str, width: int = WIDTH) -> DataFrame:
    """(id, chunk, ids): chunks of `width` tokens that share one, so that every token but the first is a target once."""
    n = F.size(tokens)
    starts = F.when(n > 1, F.sequence(F.lit(0), n - 2, F.lit(width - 1))).otherwise(F.array().cast("array<int>"))
    return df.select(F.col(id).alias("id"), F.posexplode(F.transform(starts, lambda i: F.slice(tokens, i + 1, width))).alias("chunk", "ids"))
