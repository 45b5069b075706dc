"""The code graph of a project, exported file by file, and what an export reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.files import explode_lines
from . import graph, incremental, symbols


def export(spark: SparkSession, files: DataFrame, path: str, *, project: str, skeleton: bool = False) -> DataFrame:
    """Export what changed since the last export into ``path``; one row of counters and statuses.

    ``files`` has file_path, language, source, error, mtime and size. Files of the same time and size as in the cache are skipped. The graph is
    written first, as a new version, and the cache only after that, so an export that fails is done again.
    """
    listing = files.select(F.col("file_path").alias("path"), "mtime", "size")
    cache = sinks.load_cache(spark, f"{path}/cache", listing.schema)
    status = incremental.diff_listing(cache, listing)
    todo = files.join(status.where("status IN ('stale', 'new')").select(F.col("path").alias("file_path")), "file_path", "left_semi")
    good = todo.where("error IS NULL")
    found = symbols.extract_symbols(explode_lines(good).join(good.select("file_path", "language"), "file_path"))
    nodes, edges = graph.build_nodes(found, project), graph.build_edges(found, project)
    nodes = graph.skeletonize(nodes) if skeleton else nodes
    counts = status.agg(F.count_if(F.col("status") != "deleted").alias("supported"), F.count_if(F.col("status") == "fresh").alias("cached")).crossJoin(todo.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed")))
    report = spark.createDataFrame([tuple(incremental.export_report(counts).first())], incremental.export_report(counts).schema)
    if not report.where("processed > 0").isEmpty():
        prune = report.first().prune
        version = sinks.write_version(nodes, f"{path}/nodes", prune=prune, keys=["file_path"])
        sinks.write_version(edges.withColumn("file_path", F.substring_index("target", "::", 1)), f"{path}/edges", prune=prune, keys=["file_path"], version=version)
        done = listing.join(good.select(F.col("file_path").alias("path")), "path", "left_semi")
        sinks.write_version(incremental.cache_upsert(cache, done, prune=prune), f"{path}/cache", prune=True, keys=["path"], version=version)
    return report


def exported(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the last complete export."""
    return sinks.read_version(spark, f"{path}/nodes"), sinks.read_version(spark, f"{path}/edges").drop("file_path")
