"""Shared folders for intermediate tables.

Every intermediate result that has to be read more than once is written as
Parquet below the folder named in ``spark.checkpoint.dir``; executors and the
driver all see it, so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_MADE: list[str] = []


def root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only on a local master whose session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = "file://" + tempfile.mkdtemp(prefix="structlens-")
    return _FALLBACK["dir"]


def folder(spark: SparkSession, label: str) -> str:
    """A new, unused folder name below the shared root."""
    path = f"{root(spark)}/structlens/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


_ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows while something is written; the session's setting is put back.

    Ten thousand whole texts at a time, the default, take memory in the JVM and in Python for nothing.
    """
    before = spark.conf.get(_ROWS_A_BATCH)
    spark.conf.set(_ROWS_A_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_A_BATCH, before)


def keep(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = folder(spark, label)
    with batches_of(spark, 1000):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete one folder that this module named."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _MADE:
        _MADE.remove(path)


def drop_table(df: DataFrame) -> None:
    """Delete the folder behind a table made by :func:`keep`, once nothing reads it any more."""
    made = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in list(_MADE):
        if any(m.rstrip("/").endswith(path.rsplit("/", 1)[1]) for m in made):
            drop(df.sparkSession, path)


def made() -> frozenset[str]:
    """The folders of this session so far, for :func:`clear`."""
    return frozenset(_MADE)


def clear(spark: SparkSession, *, before: frozenset[str] = frozenset(), but: DataFrame | None = None) -> None:
    """Delete the intermediate tables of this session that were not there ``before``, except that behind ``but``.

    Call it once results are stored: results that are not written yet may still read them.
    """
    needed = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in but.inputFiles()} if but is not None else set()
    for path in list(_MADE):
        if path not in before and path.rsplit("/", 1)[1] not in needed:
            drop(spark, path)
