"""Every query of the library against its SQL on the smallest tables; streams against their batch versions."""

import pytest

from tapeloom import plans

from .compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert differences(spark, con, SF, plans.queries()[name], plans.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    df = plans.queries()[name](spark, SF)
    rows = df.limit(10).collect()
    assert df.columns and rows, f"{name} gives no row"


def test_stream_of_transitions_equals_batch(spark):
    q = plans.queries()
    got = q["stream_transitions"](spark, SF).groupBy("key", "was", "tag").count().collect()
    want = q["batch_transitions"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_holds_back_the_open_day(spark):
    q = plans.queries()
    got, want = (set(map(tuple, q[n](spark, SF).select("symbol", "date", "close").collect())) for n in ("stream_daily_bars", "batch_daily_bars"))
    assert got < want or got == want
    last = max(d for _, d, _ in want)
    assert all(d < last for _, d, _ in got)
