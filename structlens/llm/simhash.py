"""SimHash near-duplicates over pigeonhole blocks.

Fingerprints have 64 bits. Cut into ``distance + spare`` blocks, two fingerprints that differ in
at most ``distance`` bits agree in at least ``spare`` of them, so every choice of ``spare`` blocks is
a table whose key is their bits: close pairs meet under some key of some
table. Members of a key are verified by Hamming distance in pairs of bounded chunks; a unit
of work emits a spanning star of what it links, never the pairs. Only distinct
fingerprints are compared; documents with the same fingerprint are linked by it.

The more fingerprints there are, the more blocks are used (longer keys in more tables), so
that a key holds about as many of them at any size; every choice finds all pairs.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle of what there is; repeated rows
share fingerprint and component; documents without an id take no part in choosing component ids; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import _work
from ._blocks import paired_chunks, runs, star, units
from ._components import components
from ._text import encode, small, word_chunks

DISTANCE = 4
SHINGLE = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 majority bits of the XXH64 (seed 42) of all shingles of a text, repeats included."""
    digest, total, n, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for chunk in word_chunks(encode(text).lower()):
        words = tail + chunk
        if len(words) >= shingle:
            at = [words[i:] for i in range(shingle)]
            h = np.fromiter((digest(b" ".join(s), 42) for s in zip(*at, strict=False)), np.uint64, len(words) - shingle + 1)
            for start in range(0, len(h), 1 << 16):
                part = h[start : start + (1 << 16)]
                total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
            tail = words[len(words) - shingle + 1 :] if shingle > 1 else []
        else:
            tail = words
    if not n:
        if not tail:
            return 0
        return digest(b" ".join(tail), 42)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def compute(batches):
        for batch in small(batches):
            fp = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(compute, "doc_id long, fp long")


def tables(n: int, distance: int = DISTANCE) -> list[list[tuple[int, int]]]:
    """The (shift, width) blocks of each table, for n distinct fingerprints."""

    def cost(spare: int) -> float:
        blocks = distance + spare
        return comb(blocks, spare) * (1 + n / 2.0 ** (64 * spare // blocks) / 256)

    spare = min(range(1, 6), key=cost)
    edges = [round(64 * i / (distance + spare)) for i in range(distance + spare + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(x) for x in combinations(blocks, spare)]


def _key(table: int, blocks: list[tuple[int, int]]) -> Column:
    bits = [F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in blocks]
    return F.xxhash64(F.lit(table), *bits)


def _verify(distance: int):
    """Spanning stars (a, b) of the links in units of (key, ci, cj, side, fp)."""

    def compare(batches):
        for table in units(batches, 3):
            keys = [table.column(k).to_numpy() for k in range(3)]
            side, fp = table.column(3).to_numpy(), table.column(4).to_numpy().view(np.uint64)
            edge = runs(keys)
            size = np.diff(edge)
            left, right = [], []
            # short runs together, by distance between rows; long ones row by row
            unit = np.repeat(np.arange(len(size)), size)
            short = size[unit] <= 64
            at = np.flatnonzero(short)
            step = 1
            while step < 64 and len(at):
                at = at[at + step < len(fp)]
                at = at[unit[at + step] == unit[at]]
                if not len(at):
                    break
                hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
                left.append(hit)
                right.append(hit + step)
                step += 1
            for u in np.flatnonzero(size > 64):
                a, b = edge[u], edge[u + 1]
                cross = keys[1][a] != keys[2][a]
                first = np.arange(a, b)[side[a:b] == 0] if cross else np.arange(a, b)
                second = np.arange(a, b)[side[a:b] == 1] if cross else first
                if not len(second):
                    continue
                label = np.arange(b - a)
                for start in range(0, len(first), 256):
                    own = first[start : start + 256]
                    near = np.bitwise_count(fp[own][:, None] ^ fp[second][None, :]) <= distance
                    i, j = np.nonzero(near)
                    label = star(np.concatenate([np.arange(b - a), own[i] - a]), np.concatenate([label, second[j] - a]), b - a)
                bound = np.flatnonzero(label != np.arange(b - a))
                left.append(a + bound)
                right.append(a + label[bound])
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                label = star(i, j, len(fp)) if len(i) > len(fp) else None
                if label is not None:
                    i = np.flatnonzero(label != np.arange(len(fp)))
                    j = label[i]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], names=["a", "b"])

    return compare


def links(distinct: DataFrame, n: int, *, distance: int = DISTANCE, chunk_rows: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` whose components are those of all links."""
    keys = F.array(*[_key(t, blocks) for t, blocks in enumerate(tables(n, distance))])
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    rows = paired_chunks(rows, "key", "fp", chunk_rows).select("key", "ci", "cj", "side", "fp")
    return rows.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "fp").mapInArrow(_verify(distance), "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most ``distance`` bits."""
    prints = _work.keep(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    first = _work.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(first.select("fp"), first.count(), distance=distance))
    joined = first.join(roots, first["fp"] == roots["a"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = _work.keep(joined, "classes")
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    classes = joined.join(lowest, joined["root"] == lowest["r"]).select(F.col("fp").alias("c_fp"), "component_id")
    return prints.join(classes, prints["fp"] == classes["c_fp"]).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, all columns unchanged; of rows that share
    an id, those whose fingerprint leads to that id all stay. Rows without an id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["doc_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
