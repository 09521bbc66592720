"""Readers and writers of the domain's files: exports, documents, feeds, journals, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType
from pyspark.sql.window import Window

SECTION = StructType([StructField("columns", ArrayType(StringType())), StructField("rows", MapType(StringType(), ArrayType(DoubleType())))])
#: A company's fundamentals document.
DOCUMENT = StructType(
    [StructField("symbol", StringType()), StructField("source_url", StringType()), StructField("fetched_at", StringType()), StructField("top_ratios", MapType(StringType(), ArrayType(DoubleType()))), StructField("growth", MapType(StringType(), MapType(StringType(), DoubleType()))), StructField("pledge_pct_from_analysis", DoubleType())]
    + [StructField(s, SECTION) for s in ("quarters", "balance_sheet", "cash_flow", "shareholding")]
)


def empty_if_missing(spark: SparkSession, read, schema: StructType) -> DataFrame:
    """What read() gives; an empty table where the path does not exist."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path)


def preferred(df: DataFrame, key: str, rank: Column, tie: str) -> DataFrame:
    """One row a key, that of least rank (consolidated before standalone, index list before index list)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(rank, tie))).filter("__n = 1").drop("__n")


def export(spark: SparkSession, path: str, names: dict[str, str], numbers: list[str], needed: list[str]) -> DataFrame:
    """A CSV export with its columns renamed, numbers freed of commas and per cent signs, rows without `needed` left out."""
    df = spark.read.option("header", True).csv(path)
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"the export lacks {missing}")
    df = df.withColumns({c: F.regexp_replace(c, "[,%]", "").try_cast("double") for c in numbers if c in df.columns})
    return df.na.drop(subset=needed)


def console_csv(spark: SparkSession, path: str, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """A CSV whose header stands somewhere in the first lines under varying names: wanted maps each column to parts of
    its names. The header is looked for in the first 50 lines on the driver; the rows are read by Spark."""
    head = [r[0] for r in spark.read.text(path).limit(50).collect()]

    def found(line: str) -> dict[str, int]:
        cells = [c.strip().strip('"').lower() for c in line.split(",")]
        return {k: next((i for i, c in enumerate(cells) if any(p in c for p in parts)), -1) for k, parts in wanted.items()}

    line = next((x for x in head if min(found(x).values()) >= 0), None)
    if line is None:
        raise ValueError("no header line")
    at, n = found(line), len(line.split(","))
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(n)))
    rows = spark.read.text(path).filter(F.col("value") != line).select(cells.alias("c"))
    return rows.select(*[F.trim(F.col(f"c.c{i}")).alias(k) for k, i in at.items()]).filter(F.greatest(*[F.col(k).try_cast("double") for k in wanted]).isNotNull())


def feed(spark: SparkSession, path: str, row: str = "item") -> DataFrame:
    """Items of XML feeds: (company, subject, date, link), dates as they are written in filings."""
    schema = "title string, description string, pubDate string, link string"
    x = spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    return x.select(F.trim("title").alias("company"), F.trim("description").alias("subject"), F.try_to_timestamp("pubDate", F.lit("dd-MMM-yyyy HH:mm:ss")).alias("date"), F.trim("link").alias("link"))


def chart_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Daily bars of JSON charts: parallel arrays become rows, seconds become dates of the exchange."""
    shape = "chart struct<result:array<struct<meta:struct<symbol:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>>>>>"
    r = df.select(F.from_json(column, shape).alias("j")).select(F.explode("j.chart.result").alias("r"))
    q = F.col("r.indicators.quote")[0]
    rows = r.select(F.col("r.meta.symbol").alias("symbol"), F.explode(F.arrays_zip(F.col("r.timestamp").alias("t"), *[q[c].alias(c) for c in ("open", "high", "low", "close", "volume")])).alias("b"))
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("b.t"), "Asia/Kolkata"))
    return rows.select("symbol", day.alias("date"), *[f"b.{c}" for c in ("open", "high", "low", "close", "volume")]).filter("close is not null")


def append(df: DataFrame, path: str, schema: StructType) -> None:
    """Appends to a journal: fields it does not know are left out, those it lacks become null."""
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that df has, leaving the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def section(docs: DataFrame, name: str, lag_days: int) -> DataFrame:
    """(symbol, period_end, known_as_of, metric, value) of a document's section; short arrays end in nulls."""
    s = F.col(name)
    rows = docs.select("symbol", s["columns"].alias("c"), F.explode(s["rows"]).alias("metric", "v")).select("symbol", "metric", F.posexplode("c").alias("i", "label"), "v")
    end = F.last_day(F.to_date(F.try_to_timestamp("label", F.lit("MMM yyyy"))))
    return rows.select("symbol", end.alias("period_end"), F.date_add(end, lag_days).alias("known_as_of"), "metric", F.get("v", F.col("i")).alias("value")).filter("period_end is not null")
