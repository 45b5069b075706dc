"""Writing what was extracted: graphs, indexes and caches as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, prune: bool = False) -> DataFrame:
    """``new`` over ``old``; ``prune`` drops what ``new`` doesn't have."""
    return new if prune else old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges below ``path``; each write is committed as a whole."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def write_index(symbols: DataFrame, path: str, *, schema_version: int = 2) -> None:
    """A symbol index, partitioned by kind so that searches prune."""
    symbols.withColumn("schema_version", F.lit(schema_version)).write.mode("overwrite").partitionBy("schema_version", "kind").parquet(path)


def read_index(spark, path: str, *, schema_version: int = 2) -> DataFrame:
    return spark.read.parquet(path).where(F.col("schema_version") == schema_version).drop("schema_version")


def write_version(rows: DataFrame, path: str, *, prune: bool, keys: list[str], version: int | None = None) -> int:
    """``rows`` over the last version, as a new one: only the buckets of their keys are written. A version counts only once it is complete, and nothing that
    the last two name is deleted."""
    merge = lambda old, new: new if old is None else upsert(old, new, keys)
    last = buckets.manifest(rows.sparkSession, path)
    number = max(version or 0, last.number + 1 if last else 1)
    return buckets.commit(rows, path, keys, merge, number=number, replace=prune)


def read_version(spark, path: str) -> DataFrame:
    """The last complete version."""
    found = buckets.read(spark, path)
    if found is None:
        raise FileNotFoundError(f"no complete version below {path}")
    return found


def load_cache(spark, path: str, schema) -> DataFrame:
    """The last complete cache; an empty one if there is none, or if its columns are others."""
    found = buckets.read(spark, path)
    if found is not None and [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in schema]:
        return found
    return spark.createDataFrame([], schema)


def rebuild_text(lines: DataFrame, eol: str = "\n") -> DataFrame:
    """file_path, source: lines put together again; a carriage return anywhere makes all ends CRLF, and the last line ends too."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("file_path").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["text"]), eol), F.lit(eol)).alias("source"))
