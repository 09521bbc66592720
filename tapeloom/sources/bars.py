"""Daily bars: reading, cleaning, merging, and an adapter that makes bars from line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tapeloom.functions.windows import price_sum, ratio, rounded

BARS = StructType([StructField("symbol", StringType()), StructField("date", DateType()), *[StructField(c, DoubleType()) for c in ("open", "high", "low", "close", "volume")]])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a folder of CSV files with a header; a file without a symbol column is named after its symbol."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    return df if "symbol" in df.columns else df.withColumn("symbol", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1))


def normalize(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row a (symbol, date), the last written (by the order column); without those that lack a close.

    Prices and volume become numbers (what is none becomes null; a null volume is 0), NaN becomes null.
    """
    missing = [c for c in ("symbol", "date", "open", "high", "low", "close", "volume") if c not in df.columns]
    if missing:
        raise ValueError(f"bars lack the columns {missing}")

    def number(c: str) -> Column:
        v = F.col(c).cast("string").try_cast("double")
        return F.when(~F.isnan(v), v)

    seq = F.col(order) if order else F.lit(0)
    tidy = df.select("symbol", F.col("date").cast("string").try_cast("date").alias("date"), *[number(c).alias(c) for c in ("open", "high", "low", "close")], F.coalesce(number("volume"), F.lit(0.0)).alias("volume"), seq.alias("__seq"))
    last = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc("__seq"), F.desc("close"), F.desc("volume")))
    return tidy.filter("close is not null and date is not null").withColumn("__n", last).filter("__n = 1").drop("__n", "__seq")


def complete_only(bars: DataFrame, today: Column, before_close: Column) -> DataFrame:
    """Without the bar of today while the session is still open."""
    return bars.filter(~((F.col("date") == today) & before_close))


def upsert(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Old and new bars together, new ones winning; among equal dates of one side the last by the order column, or without
    one the largest close and volume (of tables that have them)."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    ties = [c for c in (order, "close", "volume") if c in old.columns]
    last = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc("__src"), *[F.desc(c) for c in ties]))
    return both.withColumn("__n", last).filter("__n = 1").drop("__n", "__src")


def manifest(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def adjustments(old: DataFrame, new: DataFrame, beyond: float = 0.30, least: int = 2, priced: bool = True) -> DataFrame:
    """Median of new / old closes over common dates; beyond the bound, the history was rewritten (split, bonus). Dates without
    a positive old close are no overlap; with priced=False they count, their ratio infinite or NaN."""
    both = old.select("symbol", "date", F.col("close").alias("was")).join(new.select("symbol", "date", F.col("close").alias("now")), ["symbol", "date"])
    if priced:
        both = both.filter("was > 0")
    change = F.median(ratio(F.col("now"), F.col("was")))
    return both.groupBy("symbol").agg(F.count(F.lit(1)).alias("overlap"), F.round(change, 6).alias("ratio"), ((F.count(F.lit(1)) >= least) & (F.abs(change - 1) > beyond)).alias("adjusted"))


def benchmark(bars: DataFrame) -> DataFrame:
    """(date, bench): mean close of all symbols, from ten-thousandths, so that the order of addition changes nothing."""
    return bars.groupBy("date").agg((price_sum(F.col("close")) / (F.count("close") * F.lit(10_000.0))).alias("bench"))


def from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of a symbol for each brand: a price walk of its line items in order of date and key.

    Line items meet by symbol and day; only a row a day is put in the order of the symbol, to add what was walked before.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("date"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("symbol"))
    step = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_suppkey") * 3) % 201 - 100
    w = Window.partitionBy("symbol", "date").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ticks = items.join(part, items.l_partkey == part.p_partkey).withColumn("st", step).withColumn("k", F.row_number().over(w))
    ticks = ticks.withColumn("walk", F.sum("st").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = ticks.groupBy("symbol", "date").agg(
        F.min_by("walk", "k").alias("open"), F.max("walk").alias("high"), F.min("walk").alias("low"), F.sum("st").alias("close"), F.sum(F.col("l_quantity").cast("long")).alias("volume")
    )
    before = F.coalesce(F.sum("close").over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("before", before)
    price = {c: rounded(100 * F.exp((F.col("before") + F.col(c)) / F.lit(3000.0)), 2).alias(c) for c in ("open", "high", "low", "close")}
    return days.select("symbol", "date", *price.values(), "volume")
