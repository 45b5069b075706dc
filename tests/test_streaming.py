"""The streaming index ends where the batch does."""

import datetime

from pyspark.sql import functions as F

from structlens.operators import incremental
from structlens.streaming import index

SCHEMA = "path string, version timestamp, signature_hash string, content_hash string, deleted boolean"


def _events():
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    return [("a", at(1), "s", "c", False), ("b", at(1), "s", "c", False), ("a", at(2), "s", "d", False), ("a", at(3), "t", "d", False), ("a", at(4), "t", "d", False), ("b", at(5), "s", "c", True), ("c", at(6), "s", "c", False)]


def test_classify(spark, tmp_path):
    rows = _events()
    for i in range(2):
        spark.createDataFrame(rows[i * 4 : i * 4 + 4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = index.classify_stream(stream.drop("deleted")).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.path, r.version, r.change) for r in spark.table("changes").collect()}
    batch = incremental.classify_changes(spark.createDataFrame(rows, SCHEMA).drop("deleted"))
    assert got == {(r.path, r.version, r.change) for r in batch.collect()}


def test_merge(spark, tmp_path):
    rows = _events()
    for i in range(2):
        spark.createDataFrame(rows[i * 4 : i * 4 + 4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index.merge_batches(stream, str(tmp_path / "ix"), str(tmp_path / "ck")).awaitTermination(120)
    last = index.read_merged(spark, str(tmp_path / "ix"))
    want = index.latest_per_path(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in last.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}
    assert {r.path for r in last.select(F.col("path")).collect()} == {"a", "c"}
    assert {r.path for r in index.read_merged(spark, str(tmp_path / "ix"), tombstones=True).where("deleted").collect()} == {"b"}


def _merged(spark, folder, batches):
    """One run of the stream for each list of events."""
    for events in batches:
        spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(folder / "in"))
        index.merge_batches(stream, str(folder / "ix"), str(folder / "ck")).awaitTermination(120)


def test_late_events_and_untouched_buckets(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    _merged(spark, tmp_path, [[(f"p{i}", at(1), "s", "c", False) for i in range(40)], [("p0", at(9), "s", "c", True)], [("p0", at(3), "t", "c", False), ("p1", at(3), "t", "c", False)]])
    got = {r.path: r.signature_hash for r in index.read_merged(spark, str(tmp_path / "ix")).collect()}
    # the late event doesn't bring p0 back
    assert got == {f"p{i}": "t" if i == 1 else "s" for i in range(1, 40)}
    assert len(list((tmp_path / "ix" / "v=1").glob("bucket=*"))) == 1


def test_a_missing_predecessor_is_an_error(spark, tmp_path):
    import shutil

    import pytest

    at = datetime.datetime(2024, 1, 1)
    _merged(spark, tmp_path, [[("a", at, "s", "c", False)], [("b", at, "s", "c", False)]])
    shutil.rmtree(tmp_path / "ix" / "v=1")
    with pytest.raises(Exception, match="missing"):
        _merged(spark, tmp_path, [[("c", at, "s", "c", False)]])
