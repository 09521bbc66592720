"""Registry of queries, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.sources import bars as bar_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Bars of the adapter, as common table expressions that other queries begin with.
BARS_SQL = """WITH ticks AS (
  SELECT p_brand AS symbol, l_shipdate::date AS date, l_quantity,
    (l_orderkey*31 + l_partkey*7 + l_linenumber*13 + l_suppkey*3) % 201 - 100 AS st,
    row_number() OVER (PARTITION BY p_brand ORDER BY l_shipdate::date, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
priced AS (SELECT *, round(100*exp(sum(st) OVER (PARTITION BY symbol ORDER BY k ROWS UNBOUNDED PRECEDING)/3000.0), 2) AS px FROM ticks),
bars AS (SELECT symbol, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(l_quantity::bigint)::bigint AS volume
  FROM priced GROUP BY 1, 2)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_source.from_lineitem(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, on_bars: bool = False):
    """Registers a query under its function's name; sql on bars goes on from the common table expressions of bars."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = BARS_SQL + (", " if sql.lstrip().split(None, 1)[0].upper() != "SELECT" else " ") + sql.strip() if on_bars else sql.strip()
        return f

    return put
