"""Document fingerprints: weighted SimHash, and all fingerprints within a Hamming radius from permuted block tables.

Terms are the runs of 8 code points of a text in lower case, those at its start padded, so texts of any script and length have as many terms
as code points, and an edit touches only the terms around it. A term that occurs n times weighs 1 + log2(n), in
sixteenths; its 64-bit hash votes with its weight for or against every bit, and the sign of the votes is the fingerprint. Likeness is the
share of equal bits.

Search cuts fingerprints into blocks and keeps one table for each choice of some of them, in which the bits are permuted so that the
chosen blocks lead; close fingerprints agree in the leading bits in some table (``simhash.tables`` picks how many blocks,
by the number of fingerprints). A table is dealt and sorted by its leading bits, queries meet the run that shares theirs, and the rest
of the bits is compared by XOR. Equal fingerprints are one row with a multiplicity, a pair counts in the first table that it meets in,
and only counts leave a task, so groups of copies or near copies are never expanded; a run that is longer than ``chunk_rows``
is cut into chunks by hash, each of which meets all queries of the run.

Each document is also compared with its edited text and with the next document. Documents are dealt once by ranges of (id, hash) and sorted; neighbours
inside a task meet there, and the two rows at the border of tasks are written and joined by the numbers of the tasks.

Defined results: a null text is empty; an empty text has fingerprint zero; rows without an id come first; rows that
share an id are ordered by a hash of the text, and repeated rows follow each other; the next document of the only one is itself; an
empty table gives an empty result; other columns are ignored. Long texts are hashed in slices of bounded size; what grows is the number of different terms.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _work
from ._blocks import units
from ._text import mix
from .simhash import tables

TERM, RADIUS = 8, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_START = np.full(TERM - 1, 0x110000, np.uint32)
_SLICE = 1 << 20
#: The places of the set bits of every byte, as 1 and -1.
_SIGNS = (2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64) - 1).astype(np.float64)
_FIRST = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long, text string"


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the different terms of a text, sorted, and how often each occurs."""
    points = np.concatenate([_START, _code_points(text.lower())])
    found, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, len(points) - TERM + 1, _SLICE):
        part = points[at : at + _SLICE + TERM - 1].astype(np.uint64)
        h = np.zeros(len(part) - TERM + 1, np.uint64)
        for k in range(TERM):
            h *= _BASE
            h += part[k : k + len(h)]
        own, n = np.unique(mix(h), return_counts=True)
        if len(found):
            own, where = np.unique(np.concatenate([found, own]), return_inverse=True)
            n = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
        found, counts = own, n
    return found, counts


def fingerprint(text: str | None) -> int:
    """The signs of the weighted votes of all terms; a tie is no."""
    found, counts = terms(text or "")
    if not len(found):
        return 0
    weights = np.floor(16 * (1 + np.log2(counts)))
    octets = found.view(np.uint8).reshape(-1, 8)
    bits = [np.bincount(octets[:, b], weights, 256) @ _SIGNS > 0 for b in range(8)]
    return int(np.packbits(np.concatenate(bits), bitorder="little").view(np.uint64)[0])


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many code points (or all) of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits of two fingerprints."""
    return (64 - F.bit_count(a.bitwiseXOR(b))) / F.lit(64.0)


def _row(part: int, doc_id: int | None, text: str, fp: int, following: str, next_fp: int) -> tuple:
    new = edited(text, following)
    return (0, part, doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, _signed(fingerprint(new)), next_fp, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _FIRST.split(", ")])


def _neighbours(batches):
    """Sorted documents: a row each but for the last of the task (kind 0), the first (kind 1) and the last (kind 2) with their texts."""
    part, before, out = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            fp = _signed(fingerprint(text))
            if before is None:
                out.append((1, part, doc_id, len(text), None, fp, None, None, text))
            else:
                out.append(_row(part, *before, text, fp))
            before = (doc_id, text, fp)
            if len(out) >= 1024:
                yield _batch(out)
                out = []
    if before is not None:
        out.append((2, part, before[0], len(before[1]), None, before[2], None, None, before[1]))
        yield _batch(out)


def _border(batches):
    """(part, doc_id, fp, text, next_text, next_fp) of the last document of each task and the first of the next one."""
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("part", "doc_id", "fp", "text", "next_text", "next_fp")]
        rows = [_row(part, doc_id, text, fp, following, next_fp) for part, doc_id, fp, text, following, next_fp in zip(*columns, strict=True)]
        if rows:
            yield _batch(rows)


def with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp (signed longs) of every document; see :func:`edited`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # equal rows may stand in any order, so where they are read is enough to deal many of them to several tasks
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "tie", "place"]
    found = _work.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_neighbours, _FIRST), "neighbours")
    ends = found.where("kind > 0")
    parts = ends.where("kind = 1").select("part")  # a row a task
    follows = parts.select("part", F.lead("part").over(W.orderBy("part")).alias("n"), F.min("part").over(W.partitionBy()).alias("least")).select(F.col("part").alias("p"), F.coalesce("n", "least").alias("following"))
    first = ends.where("kind = 1").select(F.col("part").alias("q"), F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    last = ends.where("kind = 2").select("part", "doc_id", "fp", "text")
    border = last.join(follows, F.col("part") == F.col("p")).join(first, F.col("following") == F.col("q")).select("part", "doc_id", "fp", "text", "next_text", "next_fp").mapInArrow(_border, _FIRST)
    columns = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"]
    return found.where("kind = 0").select(*columns).unionByName(border.select(*columns))


def _permuted(blocks: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The leading bits (chosen blocks) and the others of ``fp``, each as one long."""

    def together(pieces: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for shift, width in pieces:
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)))
        return out

    others, at = [], 0
    for shift, width in [*sorted(blocks), (64, 0)]:
        if shift > at:
            others.append((at, shift - at))
        at = shift + width
    return together(blocks), together(others)


def _probe(choices: list[list[tuple[int, int]]], radius: int):
    """(fp, hits) of the queries in units of (table, lead, chunk, side, rest, fp, n); queries are side 0."""
    masks = [np.uint64(sum(((1 << w) - 1) << s for s, w in blocks)) for blocks in choices]

    def work(batches):
        for table in units(batches, 3):
            of, lead, chunk, side, rest, fp, n = (table.column(k).to_numpy() for k in range(7))
            rest, fp = rest.view(np.uint64), fp.view(np.uint64)
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (lead[1:] != lead[:-1]) | (chunk[1:] != chunk[:-1])
            run = np.cumsum(new) - 1
            rows_of = np.bincount(run[side == 1], minlength=run[-1] + 1)
            asked = np.flatnonzero(side == 0)
            asked = asked[rows_of[run[asked]] > 0]
            start = np.append(np.flatnonzero(new), len(of))[run[asked] + 1] - rows_of[run[asked]]  # rows come after the queries of their run
            many = rows_of[run[asked]]
            cuts = np.searchsorted(np.cumsum(many), np.arange(1 << 20, int(many.sum()) + (1 << 20), 1 << 20), "right") if len(many) else []
            for part in np.split(np.arange(len(asked)), np.unique(cuts)):
                if not len(part):
                    continue
                q = np.repeat(asked[part], many[part])
                r = np.arange(len(q)) - np.repeat(np.cumsum(many[part]) - many[part], many[part]) + np.repeat(start[part], many[part])
                near = np.bitwise_count(rest[q] ^ rest[r]) <= radius
                q, r = q[near], r[near]
                apart, first = fp[q] ^ fp[r], np.ones(len(q), bool)
                for t, mask in enumerate(masks[:-1]):
                    first &= (of[q] <= t) | (apart & mask != 0)
                if first.any():
                    hits = np.bincount(q[first], n[r[first]])
                    found = np.flatnonzero(hits)
                    yield pa.RecordBatch.from_arrays([pa.array(fp[found].view(np.int64)), pa.array(hits[found].astype(np.int64))], names=["fp", "hits"])

    return work


def within(prints: DataFrame, queries: DataFrame, *, radius: int = RADIUS, chunk_rows: int = 4096) -> DataFrame:
    """asked (every different fingerprint ``fp`` of ``queries``) and hits: the rows of ``prints`` (fp) at most ``radius`` bits away."""
    rows = _work.keep(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "prints")
    choices = tables(rows.count(), radius)

    def table(of: DataFrame, side: int) -> DataFrame:
        each = F.array(*[F.struct(F.lit(t).alias("t"), lead.alias("lead"), rest.alias("rest")) for t, (lead, rest) in enumerate(map(_permuted, choices))])
        return of.select("fp", "n", F.explode(each).alias("e")).select(F.col("e.t").alias("t"), F.col("e.lead").alias("lead"), F.lit(side).alias("side"), F.col("e.rest").alias("rest"), "fp", "n")

    asked = table(queries.select("fp").distinct().withColumn("n", F.lit(0).cast("long")), 0)
    held = table(rows, 1)
    long = held.groupBy("t", "lead").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") > chunk_rows).select(F.col("t").alias("ht"), F.col("lead").alias("hl"), F.ceil(F.col("of") / chunk_rows).cast("int").alias("chunks"))
    long = _work.keep(long, "long-runs")
    if long.take(1):
        on = lambda side: (side["t"] == long["ht"]) & (side["lead"] == long["hl"])
        chunks = F.coalesce("chunks", F.lit(1))
        held = held.join(long, on(held), "left").withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
        asked = asked.join(long, on(asked), "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    else:
        held, asked = held.withColumn("chunk", F.lit(0)), asked.withColumn("chunk", F.lit(0))
    columns = ["t", "lead", "chunk", "side", "rest", "fp", "n"]
    dealt = asked.select(*columns).unionByName(held.select(*columns)).repartition("t", "lead", "chunk").sortWithinPartitions("t", "lead", "chunk", "side")
    return dealt.mapInArrow(_probe(choices, radius), "fp long, hits long").groupBy(F.col("fp").alias("asked")).agg(F.sum("hits").alias("hits"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and its successor; ``n_within``, for ids divisible by 20, counts the other documents within 3 bits."""
    found = _work.keep(with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")), "prints-of-documents")
    asking = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    queries = found.where(asking)
    near = within(found.select("fp"), queries)
    counted = queries.join(near, queries["fp"] == near["asked"]).withColumn("n_within", F.col("hits") - 1).drop("asked", "hits")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return counted.unionByName(found.where(~asking).withColumn("n_within", F.lit(None).cast("long"))).select(
        "doc_id", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_within",
    )
