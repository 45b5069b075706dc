"""The index as a stream: every file version is an event, the state is the last fingerprint of each path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship
from ..sources import buckets

RESULT = "path string, version timestamp, change string"
STATE = "version timestamp, signature_hash string, content_hash string"


def _classify(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else None
    for frame in frames:
        rows = frame.sort_values("version", kind="stable")
        if last is not None:
            rows = rows[rows["version"] >= pd.Timestamp(last[0])]  # older than what is known: late, and ignored
        if rows.empty:
            continue
        before = [(None, None)] if last is None else [last[1:]]
        signature = [before[0][0], *rows["signature_hash"]]
        content = [before[0][1], *rows["content_hash"]]
        pairs = pd.DataFrame({"s0": signature[:-1], "s1": signature[1:], "c0": content[:-1], "c1": content[1:]}, dtype=object)
        change = pd.Series("ArchitectureUpdate", index=pairs.index).mask(pairs["s0"] == pairs["s1"], "PartialUpdate").mask(pairs["c0"] == pairs["c1"], "Skip")
        if last is None:
            change.iloc[0] = "FullUpdate"
        newest = rows.iloc[-1]
        last = (newest["version"].to_pydatetime(), newest["signature_hash"], newest["content_hash"])
        yield pd.DataFrame({"path": key[0], "version": rows["version"].to_numpy(), "change": change.to_numpy()})
    if last is not None:
        state.update(last)


def classify_stream(versions: DataFrame) -> DataFrame:
    """path, version, change for a stream of (path, version, signature_hash, content_hash)."""
    ship(versions.sparkSession)
    return versions.groupBy("path").applyInPandasWithState(_classify, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def latest_per_path(versions: DataFrame, *, tombstones: bool = False) -> DataFrame:
    """The last version of each path: the index that a stream leaves behind. Tombstones (deleted true) remove a path, or stay, marked."""
    last = versions.groupBy("path").agg(F.max_by(F.struct("version", "signature_hash", "content_hash", "deleted"), F.struct("version", "signature_hash", "content_hash")).alias("x"))
    rows = last.select("path", "x.*").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return rows if tombstones else rows.where(~F.col("deleted")).drop("deleted")


SCHEMA = "path string, version timestamp, signature_hash string, content_hash string, deleted boolean"


def read_merged(spark: SparkSession, path: str, *, tombstones: bool = False) -> DataFrame:
    """The index that :func:`merge_batches` keeps below ``path``."""
    found = buckets.read(spark, path)
    rows = spark.createDataFrame([], SCHEMA) if found is None else found
    return rows if tombstones else rows.where(~F.col("deleted")).drop("deleted")


def merge_batches(stream: DataFrame, path: str, checkpoint: str, *, n_buckets: int = buckets.BUCKETS):
    """Start a query that merges each micro-batch into the index below ``path``, a table in buckets under a manifest (``sources.buckets``).

    A batch writes only the buckets that it touches, and reads one manifest however many batches there were. Repeating a batch after a failure repeats the
    same write. A batch whose predecessor isn't there is an error, not an empty index. Tombstones stay, so that a late event doesn't bring a path back.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = buckets.manifest(spark, path, batch_id)
        if batch_id and (before is None or before.number < batch_id - 1 or not _there(spark, f"{path}/v={batch_id - 1}")):
            raise RuntimeError(f"batch {batch_id - 1} of the index below {path} is missing")
        rows = batch.select("path", "version", "signature_hash", "content_hash", F.coalesce("deleted", F.lit(False)).alias("deleted"))
        together = lambda old, new: latest_per_path(new if old is None else new.unionByName(old), tombstones=True)
        buckets.commit(rows, path, ["path"], together, number=batch_id, buckets=n_buckets)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
