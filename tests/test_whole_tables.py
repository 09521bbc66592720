"""Queries over whole tables, with a row for every key."""

import pytest

from tapeloom import plans
from tapeloom.plans.base import bars

from .compare import connect, differences


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equity_of_every_symbol(spark, sf):
    got = {r["symbol"] for r in plans.queries()["equity_stats"](spark, sf).collect()}
    assert got == {r["symbol"] for r in bars(spark, sf).select("symbol").distinct().collect()}
    assert differences(spark, connect(sf), sf, plans.queries()["equity_stats"], plans.oracle_sql()["equity_stats"]) == ""
