"""Queries of the streams, over events written to the shared folder in parts; batch queries beside them have SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.session import new_folder
from tapeloom.streaming import streams

from .base import query, table


def source(spark, sf, *columns):
    """Events in two files by time, as a stream."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tag"), "value")
    path = new_folder(spark, "events")
    for early in (True, False):
        e.filter((F.col("ts") < "2024-01-15") == early).coalesce(1).write.mode("append").parquet(path)
    return streams.follow(spark, path, e.schema)


@query()
def stream_transitions(spark, sf):
    return streams.run_available(spark, streams.transitions(source(spark, sf).select("key", "ts", "tag")))


@query("WITH p AS (SELECT user_id AS key, ts, event_type AS tag, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS was FROM events) SELECT key, was, tag, count(*) AS n FROM p WHERE was <> tag GROUP BY 1, 2, 3")
def batch_transitions(spark, sf):
    """What the stream of transitions gives, counted, from the table at once."""
    was = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_type"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), was.alias("was"), F.col("event_type").alias("tag"))
    return e.filter("was <> tag").groupBy("key", "was", "tag").agg(F.count(F.lit(1)).alias("n"))


@query()
def stream_ep_dedupe(spark, sf):
    s = source(spark, sf).withColumn("day", F.to_date("ts"))
    return streams.run_available(spark, streams.once_within(s.select("key", "tag", "day", "ts"), ["key", "tag", "day"], "ts", "10 days"))


@query()
def stream_daily_bars(spark, sf):
    ticks = source(spark, sf).select(F.col("tag").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).cast("long").alias("size"))
    return streams.run_available(spark, streams.daily_bars(ticks))


@query("SELECT event_type AS symbol, ts::date AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY 1, 2")
def batch_daily_bars(spark, sf):
    e = table(spark, sf, "events")
    v = F.col("value")
    return e.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg(F.min_by(v, "ts").alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, "ts").alias("close"), F.count(F.lit(1)).alias("volume"))
