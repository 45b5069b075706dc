"""Keeping an index up to date: fingerprints, change classes, stale and deleted files, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.sinks import upsert


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds per key the sorted distinct exports and imports and the signature text "e:a,e:b,i:c"."""
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("direction") == "export", F.col("name")))).alias("exports"), F.array_sort(F.collect_set(F.when(F.col("direction") == "import", F.col("name")))).alias("imports"))
    mark = lambda c, p: F.transform(c, lambda x: F.concat(F.lit(p), x))
    return out.select(*keys, F.array_join(F.concat(mark(F.col("exports"), "e:"), mark(F.col("imports"), "i:")), ",").alias("signature"))


def classify_changes(versions: DataFrame) -> DataFrame:
    """Adds change to (path, version, signature_hash, content_hash, api): against the version before.

    No version before: FullUpdate; the same content: Skip; else the same signature: PartialUpdate; else ArchitectureUpdate.
    """
    w = W.partitionBy("path").orderBy("version")
    before = versions.withColumns({"s0": F.lag("signature_hash").over(w), "c0": F.lag("content_hash").over(w), "nth": F.row_number().over(w)})
    change = F.when(F.col("nth") == 1, "FullUpdate").when(F.col("content_hash").eqNullSafe(F.col("c0")), "Skip").when(F.col("signature_hash").eqNullSafe(F.col("s0")), "PartialUpdate").otherwise("ArchitectureUpdate")
    return before.withColumn("change", change).drop("s0", "c0", "nth")


def diff_listing(cache: DataFrame, listing: DataFrame) -> DataFrame:
    """path, status (fresh, stale, new, deleted) of a listing (path, mtime, size) against a cache of the same columns."""
    c = cache.select(F.col("path").alias("c_path"), F.col("mtime").alias("c_mtime"), F.col("size").alias("c_size"))
    both = listing.join(c, listing["path"] == c["c_path"], "full_outer")
    same = F.col("mtime").eqNullSafe(F.col("c_mtime")) & F.col("size").eqNullSafe(F.col("c_size"))
    status = F.when(F.col("c_path").isNull(), "new").when(F.col("path").isNull(), "deleted").when(same, "fresh").otherwise("stale")
    return both.select(F.coalesce("path", "c_path").alias("path"), status.alias("status"))


def refresh(index: DataFrame, cache: DataFrame, listing: DataFrame, extract) -> tuple[DataFrame, DataFrame]:
    """The index (file_path, ...) and cache after a refresh: deleted files go, stale and new ones are extracted again.

    ``extract`` takes the listing rows to read and returns index rows.
    """
    status = diff_listing(cache, listing)
    todo = listing.join(status.where("status IN ('stale', 'new')").select("path"), "path", "left_semi")
    drop = status.where("status <> 'fresh'").select(F.col("path").alias("file_path"))
    new = index.join(drop, "file_path", "left_anti").unionByName(extract(todo))
    return new, listing.select("path", "mtime", "size")


def most_recent(rows: DataFrame, cap: int, by: str, *ties: str) -> DataFrame:
    """The ``cap`` rows that were used last."""
    return rows.orderBy(F.desc(by), *ties).limit(cap)


def cache_upsert(cache: DataFrame, done: DataFrame, *, prune: bool) -> DataFrame:
    """The cache after an export; a full export prunes, one that skipped cached files doesn't."""
    return upsert(cache, done, ["path"], prune=prune)


def export_status(supported: Column, processed: Column, failed: Column) -> Column:
    """Text status of an export run."""
    return F.when((processed > 0) & (failed > 0), "partial").when(processed > 0, "exported").when(failed > 0, "failed").when(supported == 0, "empty").otherwise("up_to_date")


def export_outcome(supported: Column, processed: Column, cached: Column, failed: Column) -> Column:
    failures = F.when((processed > 0) | (cached > 0), "partial_success").otherwise("full_failure")
    return F.when(supported == 0, "no_supported_files").when(failed > 0, failures).when(processed > 0, "complete_success").otherwise("cached_reuse")


def refresh_kind(supported: Column, processed: Column, cached: Column, failed: Column) -> Column:
    fresh = F.when(cached > 0, "partial_refresh").otherwise("full_refresh")
    return F.when(processed > 0, fresh).when((supported == 0) | (failed > 0), "no_refresh").otherwise("cached_reuse")


def update_class(outcome: Column, cached: Column) -> Column:
    """What an export means for those who read it."""
    return F.when(outcome == "full_failure", "failed").when(outcome.isin("cached_reuse", "no_supported_files"), "unchanged").when((outcome == "partial_success") | (cached > 0), "incremental").otherwise("fresh")


def export_report(runs: DataFrame) -> DataFrame:
    """Adds status, outcome, refresh, update_class, safe and prune to counters (supported, processed, cached, failed)."""
    s, p, c, f = (F.col(x) for x in ("supported", "processed", "cached", "failed"))
    out = runs.withColumns({"status": export_status(s, p, f), "outcome": export_outcome(s, p, c, f), "refresh": refresh_kind(s, p, c, f), "safe": (s > 0) & (f == 0), "prune": c == 0})
    return out.withColumn("update_class", update_class(F.col("outcome"), c))
