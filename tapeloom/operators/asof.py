"""Time joins: the last, first or nearest row of another table by time, within equal keys; no pair of rows is built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, exact: bool = True, order: str | None = None, forward: bool = False) -> DataFrame:
    """left with value of the last right row (value not null) at or before its time (exact=False: before); with forward,
    of the first one at or after it (exact=False: after).

    One shuffle by the keys: both sides are put in one order of time and the value is carried along, so that no pair
    of rows is ever built. At equal times right rows stand first if exact, else last; among right rows of one time the
    last by the order column counts, or without one the largest value. Right rows without key or time match nothing. A
    column of left with the value's name is replaced.
    """
    extra = [c for c in left.columns if c not in (*by, on, value)]
    right = right.dropna(subset=[*by, on]).select(*by, on, value, (F.col(order) if order else F.col(value)).alias("__seq"))
    seq = right.schema["__seq"].dataType
    a = left.select(*by, on, *extra, F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(True).alias("__left"), F.lit(None).cast(seq).alias("__seq"))
    b = right.select(*by, on, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra], F.col(value).alias("__v"), F.lit(False).alias("__left"), "__seq")
    time = F.desc_nulls_first(on) if forward else F.asc_nulls_first(on)
    w = Window.partitionBy(*by).orderBy(time, F.col("__left") if exact else F.col("__left").cast("int") * -1, F.col("__seq")).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__left").drop("__v", "__left", "__seq")


def within(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, days: int, value: str, order: str) -> DataFrame:
    """left with the value of the last right row (by time, then order) in the days up to its time; null if none."""
    hit = F.struct(F.col(right_on).alias("t"), F.col(value).alias("v")).alias("__hit")
    r = right.select(*by, F.col(right_on).alias(left_on), hit, F.col(order).alias("__o"))
    found = asof(left, r, by, left_on, "__hit", order="__o")
    fits = F.col("__hit.t") >= F.col(left_on) - F.make_dt_interval(F.lit(days))
    return found.withColumn(value, F.when(fits, F.col("__hit.v"))).drop("__hit")


def nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """left with the value of the right row nearest to its time (a number), before or after; among equally near ones the
    smallest value; null if there is none."""
    one = right.groupBy(*by, on).agg(F.min(value).alias("v"))
    r = one.select(*by, on, F.struct(F.col(on).alias("t"), "v").alias("__back"))
    both = asof(asof(left, r, by, on, "__back"), r.withColumnRenamed("__back", "__ahead"), by, on, "__ahead", forward=True)
    far = {c: F.abs(F.col(f"{c}.t") - F.col(on)) for c in ("__back", "__ahead")}
    ahead = F.col("__back").isNull() | (far["__ahead"] < far["__back"]) | ((far["__ahead"] == far["__back"]) & (F.col("__ahead.v") < F.col("__back.v")))
    return both.withColumn(value, F.when(ahead, F.col("__ahead.v")).otherwise(F.col("__back.v"))).drop("__back", "__ahead")
