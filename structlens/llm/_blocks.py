"""Comparing all members of a group with each other without gathering the group.

A group is cut into chunks of bounded size by a hash of its members, and every pair of
chunks is one small unit of work with at most two chunks of rows. Units are dealt
out by hash and processed run by run in sorted partitions; what leaves a unit is
linear in its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired_chunks(rows: DataFrame, group: str, member: str, chunk_rows: int) -> DataFrame:
    """``rows`` with columns ci, cj, side: each row once for every pair of chunks that its own chunk is in.

    The number of chunks of a group follows from its row count alone; a group of one chunk gets the single unit (0, 0).
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("g_n")).where("g_n > 1").withColumnRenamed(group, "g_key")
    rows = rows.join(counts, rows[group] == counts["g_key"]).drop("g_key")
    chunks = F.ceil(F.col("g_n") / F.lit(chunk_rows)).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(7)), chunks).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return rows.withColumns({"ci": F.least("own", "other"), "cj": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("other", "own", "g_n")


def units(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal values in the first ``n_keys`` columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        if held:
            last = [held[-1].column(k)[-1].as_py() for k in range(n_keys)]
            same = np.ones(batch.num_rows, bool)
            for k, v in zip(keys, last, strict=True):
                same &= k == v
            n = batch.num_rows if same.all() else int(np.argmin(same))
            held.append(batch.slice(0, n))
            if n == batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, batch, keys = [], batch.slice(n), [k[n:] for k in keys]
        start = batch.num_rows - 1
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            same &= k == k[-1]
        different = np.flatnonzero(~same)
        start = int(different[-1]) + 1 if len(different) else 0
        if start:
            yield pa.Table.from_batches([batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def runs(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of runs of equal keys, with the length at the end."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def star(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n items over the links left[i] - right[i]."""
    label = np.arange(n)
    while True:
        # labels are roots here: the higher root of each link is hooked to the lowest one that it meets, with all that follow it
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if not len(left):
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
