"""Members that meet under a key, without ever holding all members of one key.

Rows (h, member) are cut down where they are made: of a key with more than
`most` members within one buffer only a mark goes on. The rest are sorted by
key, and one pass over the sorted rows holds `most` members of a key at a
time. Keys with at most `most` members give all their pairs; the others come
out as common keys, for the caller to treat another way. The limit is the same
whatever the size of the corpus, and counts are exact: a key is common if and
only if it has more than `most` members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import written

#: Rows that a task holds at once before it cuts and hands them on.
BUFFER = 1 << 21
#: Stands for "this key is common" in place of a member.
MARK = np.int64(-(1 << 63))


def _cut(h: np.ndarray, member: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((member, h))
    h, member = h[order], member[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    size = np.diff(np.concatenate((np.flatnonzero(new), [len(h)])))
    many = np.repeat(size > most, size)
    keep = ~many | new
    member = np.where(many & new, MARK, member)
    return h[keep], member[keep]


def cut_down(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], most: int, buffer: int = BUFFER):
    """The rows (h, member, both long) of an Arrow function, with keys of more than `most` members in a buffer as one mark each."""

    def out(h: list, m: list) -> pa.RecordBatch:
        a, b = _cut(np.concatenate(h), np.concatenate(m), most)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["h", "member"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, m, n = [], [], 0
        for batch in rows(batches):
            h.append(batch["h"].to_numpy())
            m.append(batch["member"].to_numpy())
            n += batch.num_rows
            if n >= buffer:
                yield out(h, m)
                h, m, n = [], [], 0
        if n:
            yield out(h, m)

    return run


def _pairs(h: np.ndarray, member: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of all keys of sorted whole groups with two to `most` members, and the common keys."""
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    size = np.diff(np.concatenate((first, [len(h)])))
    common = (size > most) | (member[first] == MARK)
    a, b = [], []
    for n in np.unique(size[~common]):
        if n > 1:
            group = member[first[~common & (size == n)][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            a.append(group[:, i].ravel())
            b.append(group[:, j].ravel())
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), h[first[common]]


def _walk(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, member = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(h: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
            a, b, common = _pairs(h, member, most)
            pairs = np.arange(len(a) + len(common)) < len(a)
            columns = (np.concatenate((np.zeros(len(a), np.int64), common)), np.concatenate((a, common)), np.concatenate((b, common)))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], mask=pairs), pa.array(columns[1], mask=~pairs), pa.array(columns[2], mask=~pairs)], names=["h", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, member = np.concatenate((h, batch["h"].to_numpy())), np.concatenate((member, batch["member"].to_numpy()))
            last = int(np.searchsorted(h, h[-1], "left"))  # the last key may go on in the next batch
            if last:
                yield out(h[:last], member[:last])
            h, member = h[last : last + most + 1], member[last : last + most + 1]
        if len(h):
            yield out(h, member)

    return run


def meetings(rows: DataFrame, most: int) -> DataFrame:
    """(h, a, b) from (h, member), each at most once: pairs a < b with null h, and common keys h with null a and b.

    rows may come from cut_down. No key is held by a task beyond `most` members.
    """
    return rows.repartition("h").sortWithinPartitions("h", "member").mapInArrow(_walk(most), "h long, a long, b long")


def pairs_of(met: DataFrame) -> DataFrame:
    """(ka, kb) of a table of meetings, each pair once."""
    return met.where(F.col("a").isNotNull()).select(F.col("a").alias("ka"), F.col("b").alias("kb")).distinct()


def common_keys(met: DataFrame) -> DataFrame:
    """(h) of the common keys, written, so that joins know how few they are."""
    return written(met.where(F.col("h").isNotNull()).select("h").distinct())


def salted_pairs(rows: DataFrame, group: str | None = None, salts: int = 16) -> DataFrame:
    """(ka, kb), ka < kb, each once, of all members (h, member) of the keys: one side spread over salts, the other copied to each.

    With a group, only pairs of members of different groups.
    """
    more = [F.col(group).alias("g")] if group else []
    one = rows.select("h", F.col("member").alias("ka"), *more, F.pmod(F.xxhash64("member"), F.lit(salts)).cast("int").alias("salt"))
    other = rows.select("h", F.col("member").alias("kb"), *(c.alias("g2") for c in more), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = one.join(other, ["h", "salt"]).where("ka < kb")
    return (met.where("g <> g2") if group else met).select("ka", "kb").distinct()
