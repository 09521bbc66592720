"""Stateful streams: transitions of tags, alerts once within a time, daily bars when the day is over, merges."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tapeloom.session import new_folder
from tapeloom.sources.bars import upsert

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Transitions(StatefulProcessor):
    """Emits a row where a key's tag differs from its last one; a key's first tag is a silent baseline."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("tag", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["ts", "tag"])
        was, out = (self.last.get()[0] if self.last.exists() else None), []
        for ts, tag in zip(seen["ts"], seen["tag"], strict=True):
            if was is not None and tag != was:
                out.append((key[0], ts, was, tag))
            was = tag
        self.last.update((was,))
        yield pd.DataFrame(out, columns=["key", "ts", "was", "tag"])

    def close(self) -> None:
        pass


def transitions(stream: DataFrame) -> DataFrame:
    """stream: (key long, ts timestamp, tag string)."""
    return stream.groupBy("key").transformWithStateInPandas(Transitions(), "key long, ts timestamp, was string, tag string", "Append", "None")


def once_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first event of its keys within the delay; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def daily_bars(ticks: DataFrame, late: str = "2 hours") -> DataFrame:
    """Bars of (symbol, ts, price, size), emitted when the watermark has passed the day: no bar of an open session."""
    day = F.window("ts", "1 day")
    return ticks.withWatermark("ts", late).groupBy("symbol", day).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume")
    ).select("symbol", F.to_date("window.start").alias("date"), "open", "high", "low", "close", "volume")


def merge_batches(stream: DataFrame, path: str):
    """A writer that merges each batch of bars into versions of a table: late and corrected bars win."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        (upsert(old, batch) if old is not None else batch).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge)


def run_available(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs over what there is, to files in the shared folder, and reads these."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = new_folder(spark, "stream")
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def follow(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
