"""A table in buckets under a manifest: a commit writes only the buckets that it touches.

Rows are dealt to buckets by a hash of their keys, and commit ``n`` writes ``v=n/bucket=k`` for the buckets that it changes. Then it writes a manifest that names
the live folder of every bucket; readers and the next commit read that one file, whatever number of commits there were. A commit counts once its
manifest is there, so one that fails between data and manifest changes nothing and is done again. Folders that neither the last manifest
nor the one before it names are deleted, so readers that opened the one before still find what it names.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


@dataclass
class Manifest:
    """What is live after commit ``number``: bucket -> folder below the path, and the schema of the rows."""

    number: int
    buckets: int
    live: dict[str, str]
    schema: StructType

    def text(self) -> str:
        return json.dumps({"number": self.number, "buckets": self.buckets, "live": self.live, "schema": self.schema.jsonValue()})


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The commits whose manifests are there: the last two at most."""
    _, system = _system(spark, path)
    found = system.globStatus(_path(spark, path, "_manifest", "[0-9]*.json")) or []
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)


def manifest(spark: SparkSession, path: str, before: int | None = None) -> Manifest | None:
    """The last manifest (before a commit)."""
    known = [n for n in numbers(spark, path) if before is None or n < before]
    if not known:
        return None
    _, system = _system(spark, path)
    stream = system.open(_path(spark, path, "_manifest", f"{known[-1]}.json"))
    try:
        found = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()
    return Manifest(found["number"], found["buckets"], found["live"], StructType.fromJson(found["schema"]))


def _rows(spark: SparkSession, path: str, of: Manifest, folders: list[str]) -> DataFrame:
    return spark.read.schema(of.schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], of.schema)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that are live; null if nothing was ever committed."""
    of = manifest(spark, path)
    return None if of is None else _rows(spark, path, of, sorted(of.live.values()))


def commit(rows: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame], *, number: int | None = None, replace: bool = False, buckets: int = BUCKETS) -> int:
    """Write ``merge(what is live in the touched buckets, rows)``; with ``replace`` nothing else stays live. Returns the number of the commit.

    ``merge`` must keep rows in the buckets of their keys. Repeating a commit under its number repeats the same write.
    """
    spark = rows.sparkSession
    last = manifest(spark, path, number)
    number = number if number is not None else (last.number + 1 if last else 1)
    many = last.buckets if last else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(many)).cast("int")
    held = rows.persist()
    try:
        touched = {f"bucket={r.b}" for r in held.select(bucket.alias("b")).distinct().collect()}
        known = [] if last is None or replace else [f for b, f in sorted(last.live.items()) if b in touched]
        merged = merge(_rows(spark, path, last, known) if known else None, held)
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
        schema = merged.schema
    finally:
        held.unpersist()
    _, system = _system(spark, path)
    written = {f.getPath().getName() for f in system.globStatus(_path(spark, path, f"v={number}", "bucket=*")) or []}
    live = {} if last is None or replace else {b: f for b, f in last.live.items() if b not in touched}
    live |= {b: f"v={number}/{b}" for b in written}
    _publish(spark, path, Manifest(number, many, live, schema))
    _clean(spark, path, number)
    return number


def _publish(spark: SparkSession, path: str, of: Manifest) -> None:
    _, system = _system(spark, path)
    draft, final = _path(spark, path, "_manifest", f".{of.number}.draft"), _path(spark, path, "_manifest", f"{of.number}.json")
    stream = system.create(draft, True)
    try:
        stream.write(of.text().encode())
    finally:
        stream.close()
    system.delete(final, False)
    if not system.rename(draft, final):
        raise OSError(f"the manifest of commit {of.number} below {path} could not be published")


def _clean(spark: SparkSession, path: str, number: int) -> None:
    """Delete what neither this commit nor the one before it names."""
    _, system = _system(spark, path)
    known = [n for n in numbers(spark, path) if n <= number]
    before = manifest(spark, path, number)
    needed = set(manifest(spark, path, number + 1).live.values()) | set(before.live.values() if before else ())
    for old in known[:-2]:
        system.delete(_path(spark, path, "_manifest", f"{old}.json"), False)
    for version in system.globStatus(_path(spark, path, "v=*")) or []:
        name = version.getPath().getName()
        if int(name.removeprefix("v=")) >= number:
            continue
        dead = [b for b in system.globStatus(_path(spark, path, name, "bucket=*")) or [] if f"{name}/{b.getPath().getName()}" not in needed]
        for b in dead:
            system.delete(b.getPath(), True)
        if int(name.removeprefix("v=")) < number - 1 and not any(f.startswith(f"{name}/") for f in needed):
            system.delete(version.getPath(), True)
