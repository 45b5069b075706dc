"""One pass over the rows of each file, in order: what windows can only express with one frame for each level."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def whole_groups(batches: Iterator[pa.RecordBatch], column: str = "file_path") -> Iterator[pa.Table]:
    """Tables that hold all rows of one or more groups of sorted batches; a group is never torn apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column)
        starts = group_starts(key)
        if held and held[-1].column(column)[-1] == key[0]:
            first = int(starts[1]) if len(starts) > 1 else batch.num_rows
            held.append(batch.slice(0, first))
            if first == batch.num_rows:
                continue
            batch, starts = batch.slice(first), starts[1:] - first
        if held:
            yield pa.Table.from_batches(held)
        last = int(starts[-1])
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def group_starts(key: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal values begin."""
    codes = key.dictionary_encode()
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    number = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    change = np.ones(len(number), bool)
    change[1:] = number[1:] != number[:-1]
    return np.flatnonzero(change)


def first_at_most(level: Sequence[int], limit: Sequence[int], *, candidate: Sequence[bool] | None = None, own: bool = False) -> list[int]:
    """For each place the first later one (with ``own`` the place itself counts) whose level is at most the limit; -1 if there is none.

    A stack of the candidates seen from the end: nearer ones on top, and below each only lower ones.
    """
    out, levels, places = [-1] * len(level), [], []

    def add(i: int) -> None:
        if candidate is None or candidate[i]:
            while levels and levels[-1] >= level[i]:
                levels.pop()
                places.pop()
            levels.append(level[i])
            places.append(i)

    for i in range(len(level) - 1, -1, -1):
        if own:
            add(i)
        at = bisect_right(levels, limit[i])
        if at:
            out[i] = places[at - 1]
        if not own:
            add(i)
    return out


def in_file_order(rows: DataFrame, *order: str) -> DataFrame:
    """All rows of a file in one partition, in order, for a pass in Python workers that know the package."""
    ship(rows.sparkSession)
    return rows.repartition(F.col("file_path")).sortWithinPartitions("file_path", *order)
