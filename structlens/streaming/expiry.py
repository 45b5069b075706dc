"""State that expires: summaries served from memory for a while, and the last diagnostics of each file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.read import latest_diagnostics
from ..session import ship

#: For so many seconds a summary is served as it was made.
SECONDS = 300
RESULT = "key string, asked timestamp, made timestamp, text string, cached boolean"


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store; it keeps what doesn't fit in memory on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Summaries(StatefulProcessor):
    """The last summary made for each key; a timer forgets it when it is too old for anyone."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "made timestamp, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests = pd.concat(list(rows)).sort_values(["asked", "text"], kind="stable")
        known = self.last.get() if self.last.exists() else None
        made, text = (pd.Timestamp(known[0]), known[1]) if known else (None, None)
        out, life = [], pd.Timedelta(seconds=self.seconds)
        for at, now in zip(requests["asked"], requests["text"], strict=True):
            cached = made is not None and at - made < life
            if not cached:
                made, text = at, now
            out.append((key[0], at, made, text, cached))
        self.last.update((made.to_pydatetime(), text))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((made + life).timestamp() * 1000))
        yield pd.DataFrame(out, columns=["key", "asked", "made", "text", "cached"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def served_summaries(requests: DataFrame, *, seconds: int = SECONDS, late: str = "1 hour") -> DataFrame:
    """key, asked, made, text, cached of a stream of requests (key, asked, text: what would be made now): within ``seconds`` of a
    summary it is served as it was. State is forgotten by event time, ``late`` behind the newest request."""
    use_rocksdb(requests.sparkSession)
    ship(requests.sparkSession)
    rows = requests.selectExpr("CAST(key AS STRING) AS key", "asked", "CAST(text AS STRING) AS text").withWatermark("asked", late)
    return rows.groupBy("key").transformWithStateInPandas(Summaries(seconds), RESULT, "Append", "EventTime")


def keep_diagnostics(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the last diagnostics (file_path, diagnostics, arrival) of each file below ``path``."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return latest_diagnostics(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
