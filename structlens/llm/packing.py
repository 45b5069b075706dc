"""Best-fit packing with conflicts.

Documents are cut into pieces of at most ``capacity`` words and pieces are packed, largest first, into bins. A bin
carries two bitmaps, of the sources and of the duplicate clusters in it; a piece fits if the bin's residual is large enough
and neither bitmap has the piece's bit. Open bins are held in order of residual; the search starts at the first
residual that is large enough and goes on to its successors until the tightest compatible bin is found, or a new bin is
opened. No piece is dropped: a piece that fits nowhere opens a bin.

Pieces are dealt by a hash of their document into shards of about ``shard_pieces``; a shard is packed in one task with
narrow rows only. Conflicts are about members of one bin, and bins never span shards, so shards need not know of
each other; a hot source is spread over all of them. Where a piece goes depends on the rows alone and not on how they are split or ordered:
rows with the same id, text, source and cluster are counted, and then numbered.

Defined results: null and empty texts have no pieces; a null source or cluster conflicts with nothing; two pieces of one document
are of one cluster; repeated rows are of one cluster; an empty table gives an empty result;
other columns are ignored. A source conflict can be switched off (``one_per_source=False``); then only clusters conflict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _work
from ._blocks import runs, units
from .mixing import size_of

CAPACITY = 2048
#: So many rows that are the same are numbered by one task.
SAME_ROWS = 65_536


class Bins:
    """Open bins in order of residual, with a bitmap of sources and one of clusters for each."""

    def __init__(self, capacity: int, sources: int, clusters: int):
        self.capacity, self.n, self.made = capacity, 0, 0
        self.residual, self.ident = np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.order_to_slot = self.ident
        self.sources = np.zeros((64, sources // 64 + 1), np.uint64)
        self.clusters = np.zeros((64, clusters // 64 + 1), np.uint64)

    def _free(self, at: int, source: int, cluster: int) -> int:
        """The first place from ``at`` on whose bin has neither bit; -1 if there is none."""
        step = 16
        while at < self.n:
            slots = self.ident[at : min(at + step, self.n)]
            taken = np.zeros(len(slots), bool)
            if source >= 0:
                taken |= (self.sources[slots, source >> 6] >> np.uint64(source & 63)) & np.uint64(1) != 0
            if cluster >= 0:
                taken |= (self.clusters[slots, cluster >> 6] >> np.uint64(cluster & 63)) & np.uint64(1) != 0
            if not taken.all():
                return at + int(np.argmin(taken))
            at, step = at + step, step * 2
        return -1

    def _grow(self) -> None:
        for name in ("residual", "ident", "sources", "clusters"):
            old = getattr(self, name)
            new = np.zeros((2 * len(old), *old.shape[1:]), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def put(self, size: int, source: int, cluster: int) -> int:
        """The number of the bin that the piece went to."""
        place = self._free(int(np.searchsorted(self.residual[: self.n], size)), source, cluster)
        if place < 0:
            if max(self.n, self.made) + 1 >= len(self.residual):
                self._grow()
            slot, left = self.made, self.capacity - size
            self.made += 1
        else:
            slot, left = int(self.ident[place]), int(self.residual[place]) - size
            self.residual[place : self.n - 1] = self.residual[place + 1 : self.n]
            self.ident[place : self.n - 1] = self.ident[place + 1 : self.n]
            self.n -= 1
        if source >= 0:
            self.sources[slot, source >> 6] |= np.uint64(1 << (source & 63))
        if cluster >= 0:
            self.clusters[slot, cluster >> 6] |= np.uint64(1 << (cluster & 63))
        if left > 0:
            to = int(np.searchsorted(self.residual[: self.n], left))
            self.residual[to + 1 : self.n + 1] = self.residual[to : self.n]
            self.ident[to + 1 : self.n + 1] = self.ident[to : self.n]
            self.residual[to], self.ident[to] = left, slot
            self.n += 1
        return slot


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of every piece; pieces come largest first."""
    number = {s: i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    twice = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    bins = Bins(capacity, len(number), len(twice))
    return [bins.put(n, number.get(s, -1), twice.get(c, -1)) for n, s, c in zip(sizes, sources, clusters, strict=True)]


def _shards(capacity: int):
    def work(batches: Iterator[pa.RecordBatch]):
        for table in units(batches, 1):
            edge = runs([table.column(0).to_numpy()])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                bins = pack(part.column("n_words").to_pylist(), part.column("s").to_pylist(), part.column("c").to_pylist(), capacity)
                part = part.append_column("bin", pa.array(bins, pa.int64())).select(["shard", "bin", "doc_id", "copy", "start_word", "n_words"])
                yield from part.to_batches()

    return work


def best_fit(docs: DataFrame, *, capacity: int = CAPACITY, shard_pieces: int = 4096, one_per_source: bool = True, cluster: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """shard, bin, doc_id, copy, start_word, n_words: where every piece of every document goes.

    ``cluster`` is the duplicate cluster of a row (default: a hash of the text, so copies never share a bin).
    ``copy`` numbers rows that are the same.
    """
    source = F.xxhash64(source_col) if one_per_source else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.col(source_col).isNotNull(), source).alias("s"), *([] if cluster is None else [cluster.alias("c")]), F.xxhash64(F.col(text_col).cast("string")).alias("h"), size_of(F.col(text_col)).alias("size"))
    rows = rows.where("size > 0").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("same"))
    rows = rows if cluster is not None else rows.withColumn("c", F.col("h"))
    rows = _work.keep(rows, "packing")
    per, block = F.lit(capacity).cast("long"), F.lit(SAME_ROWS).cast("long")
    n = rows.agg(F.sum(F.ceil(F.col("size") / per) * F.col("same"))).first()[0] or 0
    shards = max(1, -(-n // shard_pieces))
    # very many of the same are numbered in blocks, by as many tasks
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("same") - 1, block)))
    if n > SAME_ROWS:
        rows = rows.repartition("doc_id", "h", "first")
    rows = rows.withColumn("copy", F.explode(F.sequence("first", F.least(F.col("first") + block, F.col("same")) - 1)))
    pieces = rows.withColumn("start_word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, per)))
    pieces = pieces.withColumn("n_words", F.least(per, F.col("size") - F.col("start_word")))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", "copy", "start_word"), F.lit(shards)).cast("int"))
    pieces = pieces.select("shard", "n_words", "doc_id", "start_word", "copy", "h", "s", "c")
    dealt = pieces.repartition("shard").sortWithinPartitions("shard", F.desc("n_words"), "doc_id", "h", "s", "c", "start_word", "copy")
    return dealt.mapInArrow(_shards(capacity), "shard int, bin long, doc_id long, copy long, start_word long, n_words long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document."""
    out = best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("shard", "bin", "doc_id", "start_word", "n_words")
