"""Queries over bars whose closes fall to 0 or rise until their sums pass 64 bits, against their SQL; divisions by 0 included."""

from datetime import date, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tapeloom import plans
from tapeloom.operators import metrics as mt
from tapeloom.plans.base import BARS_SQL

from .compare import differences

DAYS = 800

#: Queries held against their SQL on closes of 0 and prices up to 2e13.
SAME = [
    "episodic_neglect",
    "extended_flags",
    "exemplar_capture",
    "focus_list",
    "capture_labels",
    "rs_percentile",
    "industry_rs_heat",
    "rs_ratios",
    "industry_heat_grid",
    "screener_table",
    "transition_alerts",
    "tag_counts",
    "rs_raw_125",
    "watchlist_tags",
    "anticipation_weekly",
    "benchmark_compare",
    "base_metrics",
    "breadth_200dma",
    "bars_with_missing_averages",
    "corrected_cagr",
    "corporate_action_check",
    "signal_outcomes_mfe_mae",
]
#: Query -> least rows and a column without nulls, on prices beyond that, where the SQL fails or there is none.
RUNS = {
    "validated_entries": (1, "validated_entry"),
    "backtest_options": (1, "shares"),
    "backtest_lots": (1, "shares"),
    "breadth_200dma": (1, "breadth_pct"),
    "bars_with_missing_averages": (25 * 199, "lacks_short"),
    "config_grid": (3, "trades"),
}


def walks(large: bool) -> dict[str, list[np.ndarray]]:
    """Steps of each symbol's price by day, 100 at most each way."""
    rng = np.random.default_rng(5)
    rise, fall, near = np.full(3, 95), np.full(3, -90), lambda: rng.integers(-40, 41, 3)
    out = {}
    for i in range(1, 26):
        days = [near() for _ in range(DAYS)]
        if i == 1:  # at 0 to the end
            days[200:350] = [fall] * 150
        elif i == 2:  # at 0 for half a year, then up again
            days[200:350], days[520:700] = [fall] * 150, [rise] * 180
        elif i == 3:  # at 0 from the first close on, then up again
            days[0], days[1:30], days[30:300] = np.full(330, -100), [np.array([0])] * 29, [rise] * 270
        elif i == 4:  # some 2e13, with 200 bars whose sum passes 64 bits
            days[100:375] = [rise] * 275
        elif i == 5 and large:
            days[100:700] = [rise] * 600
        out[f"Brand#{i}"] = days
    return out


def make(folder, large: bool) -> str:
    """Line items whose keys give these steps: the line number makes up for what the other keys leave."""
    items, order = [], 0
    for part, days in enumerate(walks(large).values()):
        for d, steps in enumerate(days):
            for st in steps:
                order += 1
                line = (int(st) + 100 - 31 * order - 7 * part) * pow(13, -1, 201) % 201
                items.append((order, part, line, date(1996, 1, 1) + timedelta(d), 1 + order % 7))
    o, p, n, day, q = (list(x) for x in zip(*items, strict=True))
    con = duckdb.connect()
    con.register("t", pa.table({"o": o, "p": p, "n": n, "d": day, "q": q}))
    con.sql(f"COPY (SELECT o::bigint AS l_orderkey, p::bigint AS l_partkey, 0::bigint AS l_suppkey, n::int AS l_linenumber, q::double AS l_quantity, 1.0::double AS l_extendedprice, d::timestamp AS l_shipdate FROM t) TO '{folder}/lineitem.parquet'")
    con.sql(f"COPY (SELECT i::bigint AS p_partkey, 'Brand#' || (i + 1) AS p_brand FROM range(25) r(i)) TO '{folder}/part.parquet'")
    return str(folder)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return {k: make(tmp_path_factory.mktemp(k), k == "large") for k in ("zeros", "large")}


class Tables:
    """The folder's tables in DuckDB, with the bars made once."""

    def __init__(self, folder):
        self.con = duckdb.connect()
        for t in ("lineitem", "part"):
            self.con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        self.con.sql(f"CREATE TABLE bars AS {BARS_SQL} SELECT * FROM bars")

    def sql(self, text):
        return self.con.sql(text.replace(f"{BARS_SQL}, ", "WITH ").replace(BARS_SQL, ""))


@pytest.fixture(scope="module")
def con(folders):
    return Tables(folders["zeros"])


def test_tables_have_what_the_tests_need(con):
    zeros, top, first = con.sql("SELECT count_if(close = 0), max(close), arg_min(close, date) FILTER (symbol = 'Brand#3') FROM bars").fetchall()[0]
    assert zeros > 500 and 1e13 < top < 9e13 and first == 0


@pytest.mark.parametrize("name", sorted(SAME))
def test_equals_sql(spark, con, folders, name):
    assert differences(spark, con, folders["zeros"], plans.queries()[name], plans.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(RUNS))
def test_whole_result(spark, folders, name):
    """Where the SQL itself fails or is none: as many rows as named, none of a column's values missing that has to be there."""
    rows, column = RUNS[name]
    got = plans.queries()[name](spark, folders["large"]).collect()
    assert len(got) >= rows and all(x[column] is not None for x in got)


def test_outcomes_without_risk_as_the_sql_has_them(spark):
    signals = spark.sql("SELECT 1 AS id, 'A' AS symbol, DATE'2020-06-15' AS date, 0.0D AS close, 0.0D AS stop")
    bars = spark.sql("SELECT 'A' AS symbol, DATE'2020-06-16' AS date, 0.01D AS high, 0.0D AS low, 0.0D AS close")
    got = mt.outcomes(signals, bars, by_zero=True).first()
    assert got["max_favorable_r"] == float("inf") and str(got["max_adverse_r"]) == "nan" and got["r_to_date"] == -1.0


def test_outcomes_round_as_the_sql_does(spark):
    x = 3.229578260549512e38
    signals = spark.sql("SELECT 1 AS id, 'A' AS symbol, DATE'2020-06-15' AS date, 1.0D AS close, 0.0D AS stop")
    bars = spark.createDataFrame([("A", date(2020, 6, 16), x, 1.0, 1.0)], "symbol string, date date, high double, low double, close double")
    assert mt.outcomes(signals, bars).first()["max_favorable_r"] == duckdb.sql(f"SELECT round({x!r}::double, 4)").fetchall()[0][0]
