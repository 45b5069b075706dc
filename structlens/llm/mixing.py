"""Mixing sources to target weights with a time-varying curriculum.

Every source has a target number of words and a weight schedule over training
time 0..1. The schedule is integrated to a cumulative demand; the words of
a source, laid out in a pseudo-random but fixed order of its documents and repeated
as often as allowed, are mapped through the inverse of that demand to positions
on the training axis, and the mix is the range sort of all documents by position.

The running sum of sizes inside a source never passes through one task: the order
key deals a source into about sqrt(rows) buckets, sums run inside
buckets, and one row a bucket carries the sums across.

Defined results: null text has size 0; a null source is a source of its own, last
in order; repeated rows are separate documents; the order key is a hash of id and text, so rows that share it are
the same document and may change places without a change in the result; an empty table gives an empty result; other columns are ignored by
:func:`plan` and kept by :func:`mixed_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _work
from ._text import WORD

WEIGHTS = (3, 1, 2)
#: Weight over time as (time, weight) points, by place in WEIGHTS: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Up to so many sources, targets reach the documents by a broadcast (under 10 MB); beyond, by a join.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Words in a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, place, source_size, n, target from (source, size): the level at which
    min(most * source_size, level * weight) sums up to the demand."""
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    by_level = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    level = (F.col("demand") - F.col("before")) / F.col("left")
    return (
        stats.withColumn("place", place)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") + 1))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("demand", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("before", before)
        .withColumn("left", left)
        .withColumn("level", F.when(level <= F.col("ratio"), level))
        .withColumn("level", F.max("level").over(every))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
        .select("source", "place", "source_size", "n", "target")
    )


def _segments(points: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(demand before, time, weight, slope) of each linear piece; the whole demand is 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(points, points[1:], strict=False):
        out.append((done, t0, w0 / area, (w1 - w0) / area / (t1 - t0)))
        done += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def position(demand: Column, place: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The time at which a source's cumulative demand reaches the share ``demand`` of its target."""
    out = F.lit(None).cast("double")
    for k, points in enumerate(schedules):
        inverse = F.lit(None).cast("double")
        for done, t0, w0, slope in _segments(points):
            over = demand - F.lit(done)
            t = over / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + over * F.lit(2 * slope), F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
            inverse = F.when(demand >= F.lit(done), t + F.lit(t0)).otherwise(inverse)
        out = F.when(place == k, inverse).otherwise(out)
    return out


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _key(source: Column) -> Column:
    """A source as a text that is never null, so that joins and windows agree on one partitioning."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _with_sources(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds sk and the columns of the source's target."""
    small = targets.count() <= BROADCAST_SOURCES
    right = targets.select(_key(F.col("source")).alias("t_key"), "place", "source_size", "target")
    rows = rows.withColumn("sk", _key(F.col("source")))
    return rows.join(F.broadcast(right) if small else right, rows["sk"] == right["t_key"]).drop("t_key")


def laid_out(rows: DataFrame, targets: DataFrame, *, most: int = 2, cut: str = "word") -> DataFrame:
    """Adds source_size, target, place, and ``uses``: the (offset, words) of each use of a document.

    ``rows`` has doc_id, source, size, digest (a hash of the text) and tie (what else tells rows apart). cut="word" ends a source at the very word where its target
    is met; cut="document" takes whole documents, the last one if at least half of it fits.
    """
    most_rows = targets.agg(F.max("n")).first()[0] or 1
    buckets = max(1, math.isqrt(most_rows))
    # with the text's hash, rows of one id, or without any, spread over all buckets
    key = F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest")))
    rows = _with_sources(rows.withColumn("k", key), targets)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("k", 1, 8), 16, 10).cast("long") * buckets / F.lit(float(1 << 32))).cast("long"))
    inside = W.partitionBy("sk", "bucket").orderBy("k", "tie").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("sk", "bucket").agg(F.sum("size").alias("words"))
    across = W.partitionBy("sk").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("sk").alias("b_key"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("words").over(across), F.lit(0)).alias("ahead"))
    own = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = own.join(sums, (own["sk"] == sums["b_key"]) & (own["bucket"] == sums["b_bucket"]))
    goal = F.round("target").cast("long")
    uses = []
    for use in range(most):
        offset = F.col("ahead") + F.col("within") + F.col("source_size") * use
        left = goal - offset
        words = F.greatest(F.lit(0), F.least(left, F.col("size"))) if cut == "word" else F.when((left > 0) & (left * 2 >= F.col("size")), F.col("size")).otherwise(F.lit(0))
        uses.append(F.struct(offset.alias("offset"), words.cast("long").alias("words")))
    uses = F.filter(F.array(*uses), lambda u: u["words"] > 0)
    return both.withColumn("uses", uses).drop("k", "digest", "tie", "bucket", "within", "ahead", "sk", "b_key", "b_bucket")


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2, schedules=SCHEDULES, cut: str = "word") -> DataFrame:
    """doc_id, size, source_size, target, taken, n_uses, position (of the first use), in training order."""
    sizes = _work.keep(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), _digest(F.col(text_col)).alias("digest"), F.lit(0).cast("long").alias("tie")), "sizes")
    targets = _work.keep(source_targets(sizes, weights=weights, share=share, most=most), "targets")
    out = laid_out(sizes, targets, most=most, cut=cut)
    first = position(F.get("uses", F.lit(0))["offset"] / F.col("target"), F.col("place"), schedules)
    out = out.withColumn("taken", F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["words"]))
    out = out.select("doc_id", "size", "source_size", "target", "taken", F.size("uses").cast("long").alias("n_uses"), F.floor(first * F.lit(1e6)).cast("long").alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id", "size", "taken")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2, schedules=SCHEDULES) -> DataFrame:
    """The mix itself: one row with all columns of ``docs`` for each use of a whole document, in training order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), _digest(F.col(text_col)).alias("digest"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("tie"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    targets = _work.keep(source_targets(rows.select("source", "size"), weights=weights, share=share, most=most), "targets")
    out = laid_out(rows, targets, most=most, cut="document").select("row", "doc_id", "target", "place", F.explode("uses").alias("use"))
    at = position(F.col("use.offset") / F.col("target"), F.col("place"), schedules)
    out = out.select("row", "doc_id", at.alias("at")).repartitionByRange("at", "doc_id").sortWithinPartitions("at", "doc_id")
    return out.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: what is taken of each."""
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = """
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),
stats AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM stats),
weighed AS (
  SELECT *, CASE place WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2 * source_size AS cap,
    (SELECT CAST(sum(source_size) AS DOUBLE) FROM stats) * 1.5::DOUBLE AS demand FROM ranked),
filled AS (
  SELECT *, cap / weight AS ratio,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed),
level AS (
  SELECT max((demand - before) / rest) AS level FROM filled WHERE (demand - before) / rest <= ratio),
targets AS (
  SELECT source, place, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM level) * weight, cap::DOUBLE)) AS target FROM filled),
laid AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.place,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || s.digest) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
used AS (
  SELECT *, greatest(0, least(CAST(round(target) AS BIGINT) - ahead, size)) AS one,
    greatest(0, least(CAST(round(target) AS BIGINT) - ahead - source_size, size)) AS two FROM laid),
placed AS (
  SELECT *, CASE WHEN one > 0 THEN ahead / target WHEN two > 0 THEN (ahead + source_size) / target END AS u FROM used)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  CAST((one > 0)::INT + (two > 0)::INT AS BIGINT) AS n_uses,
  CAST(floor(CASE place WHEN 0 THEN (sqrt(greatest(1.5::DOUBLE * 1.5::DOUBLE + u * -2.0::DOUBLE, 0.0::DOUBLE)) - 1.5::DOUBLE) / -1.0::DOUBLE + 0.0::DOUBLE
    WHEN 1 THEN u / 1.0::DOUBLE + 0.0::DOUBLE
    ELSE (sqrt(greatest(0.5::DOUBLE * 0.5::DOUBLE + u * 2.0::DOUBLE, 0.0::DOUBLE)) - 0.5::DOUBLE) / 1.0::DOUBLE + 0.0::DOUBLE END * 1000000.0::DOUBLE) AS BIGINT) AS position
FROM placed
"""
