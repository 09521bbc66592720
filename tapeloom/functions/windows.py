"""Rolling columns over bars of a symbol, with the guards that rolling statistics need."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_symbol(*order: str) -> WindowSpec:
    return Window.partitionBy("symbol").orderBy(*(order or ("date",)))


def last_bars(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def _enough(c: Column, value: Column, n: int, least: int | None) -> Column:
    """value where the last n bars have least (n, if None) values that are not null."""
    return F.when(F.count(c).over(last_bars(n)) >= (n if least is None else least), value)


def roll_mean(c: Column, n: int, least: int | None = None) -> Column:
    return _enough(c, F.avg(c).over(last_bars(n)), n, least)


def ratio(a: Column, b: Column) -> Column:
    """a / b of numbers by IEEE 754, as the queries' SQL has it: by zero it is infinite or NaN, where Spark's division fails."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def rounded(c: Column, n: int) -> Column:
    """c at n places as the queries' SQL rounds: scaled, rounded and scaled back as a double, so that the last digits of large
    numbers are the same."""
    return F.round(c * 10.0**n) / 10.0**n


#: Prices from here on have no ten-thousandths in 64 bits.
FITS = 9e14


def price_sum(c: Column, w: WindowSpec | None = None) -> Column:
    """Sum of prices in ten-thousandths, of a group or over an ordered window, as a double that does not depend on the order
    of addition.

    The integers are summed in two halves, since a sum of 64-bit integers may overflow; larger prices are added as doubles,
    in the window's order or in that of their values."""

    def total(x: Column) -> Column:
        return F.sum(x) if w is None else F.sum(x).over(w)

    units = F.when(F.abs(c) < FITS, F.round(c * 10_000).cast("long"))
    exact = total(F.shiftright(units, 31)).cast("double") * 2.0**31 + total(units.bitwiseAND(2**31 - 1))
    large = F.when(F.abs(c) >= FITS, c * 10_000)
    if w is None:
        listed = F.sort_array(F.collect_list(large))
        rest = F.when(F.size(listed) > 0, F.aggregate(listed, F.lit(0.0), lambda x, y: x + y))
    else:
        rest = total(large)
    return F.when(rest.isNull(), exact).otherwise(F.coalesce(exact, F.lit(0.0)) + rest)


def roll_price_mean(c: Column, n: int, least: int | None = None) -> Column:
    return _enough(c, price_sum(c, last_bars(n)) / (F.count(c).over(last_bars(n)) * F.lit(10_000.0)), n, least)


def roll_max(c: Column, n: int, least: int | None = None) -> Column:
    return _enough(c, F.max(c).over(last_bars(n)), n, least)


def roll_min(c: Column, n: int, least: int | None = None) -> Column:
    return _enough(c, F.min(c).over(last_bars(n)), n, least)


def back(c: Column, n: int = 1, default=None) -> Column:
    return F.lag(c, n, default).over(by_symbol())


def percentile(c: Column, *group: str) -> Column:
    """100 * mean rank among those not null / their number, in a group; ties share their mean rank."""
    all_of = Window.partitionBy(*group)
    rank = F.rank().over(Window.partitionBy(*group, c.isNull()).orderBy(c))
    same = F.count(F.lit(1)).over(Window.partitionBy(*group, c))
    return F.when(c.isNotNull(), 100.0 * (rank + (same - 1) / 2) / F.count(c).over(all_of))


def clip01(c: Column) -> Column:
    """c within 0 and 1; null stays null, which least and greatest alone would not do."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
