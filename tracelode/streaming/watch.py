"""Watching for changes with Structured Streaming: latest values by key, snapshots compared batch by batch, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.tables import difference


class Latest(StatefulProcessor):
    """Holds each key's greatest (ts, event_id) and its value; says when a key is new or has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "ts timestamp, event_id long, value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        before = best
        for frame in rows:
            top = frame.nlargest(1, ["ts", "event_id"]).iloc[0]
            mine = (top["ts"].to_pydatetime(), int(top["event_id"]), float(top["value"]))
            if best is None or mine[:2] > tuple(best)[:2]:
                best = mine
        if best != before:
            self.state.update(tuple(best))
            yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[1]], "value": [best[2]], "change": ["added" if before is None else "changed"]})

    def close(self) -> None:
        pass


def latest_changes(events: DataFrame) -> DataFrame:
    """(user_id, event_id, value, change) whenever a key of a stream (user_id, ts, event_id, value) has a new last value."""
    return events.select("user_id", "ts", "event_id", "value").groupBy("user_id").transformWithStateInPandas(statefulProcessor=Latest(), outputStructType="user_id long, event_id long, value double, change string", outputMode="Update", timeMode="None")


def write_changes(stream: DataFrame, rows: str, offsets: str) -> None:
    """Runs ``latest_changes`` over what a stream has now, and adds its changes to the table at ``rows`` with their batch.

    State is held in RocksDB beside the offsets, so it is neither bound by memory nor lost with an executor.
    """
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = stream.sparkSession.conf.get(name)
    stream.sparkSession.conf.set(name, store)
    try:
        keep = lambda batch, number: batch.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(rows)
        latest_changes(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()
    finally:
        stream.sparkSession.conf.set(name, before)


def latest_values(events: DataFrame) -> DataFrame:
    """The same last values from a bounded table: one map-side combined maximum per key."""
    best = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(best.alias("x")).select("user_id", "x.event_id", "x.value")


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): tumbling counts over a stream or a table, late rows bounded by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def watch(stream: DataFrame, known: str, key: str, value: str, act: Callable[[DataFrame], None], seconds: float = 1.0, once: bool = False) -> StreamingQuery:
    """Compares every batch of a stream of snapshots (key, value) with the table at ``known`` and hands on what changed.

    Batches that come while one is at work wait and are taken together, so at most one more run is due. The snapshot is written
    beside the old one and read from there by the next batch, so a lost executor repeats a batch without harm.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        folder = f"{known}/{number % 2}"
        old = _read(spark, f"{known}/{(number + 1) % 2}", batch)
        act(difference(old, batch, key, value))
        batch.write.mode("overwrite").parquet(folder)

    trigger = {"availableNow": True} if once else {"processingTime": f"{max(0.25, seconds)} seconds"}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{known}/offsets").trigger(**trigger).start()


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path)
