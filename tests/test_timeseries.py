"""Interpolation, carry and gap filling invariants."""

from panelwright.operators import timeseries as ts


def _series(spark, rows):
    return spark.createDataFrame(rows, "k string, t int, x double")


def test_interpolation_interior_only_and_keeps_observed(spark):
    df = _series(spark, [("a", 1, None), ("a", 2, 2.0), ("a", 4, None), ("a", 6, 10.0), ("a", 7, None),
                         ("b", 1, 5.0), ("b", 3, None)])
    got = {(r.k, r.t): r.y for r in ts.interpolate(df, ["k"], "t", "x", out="y").collect()}
    assert got[("a", 1)] is None and got[("a", 7)] is None and got[("b", 3)] is None
    assert got[("a", 2)] == 2.0 and got[("a", 6)] == 10.0
    assert got[("a", 4)] == 2.0 + 8.0 * 2 / 4  # x = index: 2 + (10-2)·(4-2)/(6-2)


def test_interpolation_position_differs_from_index(spark):
    df = _series(spark, [("a", 1, 0.0), ("a", 2, None), ("a", 10, 8.0)])
    by_index = {r.t: r.y for r in ts.interpolate(df, ["k"], "t", "x", out="y").collect()}
    by_pos = {r.t: r.y for r in ts.interpolate_position(df, ["k"], "t", "x", out="y").collect()}
    assert abs(by_index[2] - 8.0 / 9.0) < 1e-12 and by_pos[2] == 4.0


def test_rule2_and_chain(spark):
    df = _series(spark, [("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("a", 4, 4.0), ("a", 5, None)])
    r2 = {r.t: r.y for r in ts.interpolate(df, ["k"], "t", "x", out="y", rule=2).collect()}
    assert [r2[t] for t in range(1, 6)] == [2.0, 2.0, 3.0, 4.0, 4.0]
    empty = _series(spark, [("z", 1, None), ("z", 2, None)])
    ch = {r.t: r.x for r in ts.fill_chain(empty, ["k"], "t", "x", gaps=False, final=0.0).collect()}
    assert ch == {1: 0.0, 2: 0.0}


def test_locf_nocb(spark):
    df = _series(spark, [("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("a", 4, 3.0), ("a", 5, None)])
    f = {r.t: r.y for r in ts.locf(df, ["k"], "t", "x", out="y").collect()}
    b = {r.t: r.y for r in ts.nocb(df, ["k"], "t", "x", out="y").collect()}
    assert [f[t] for t in range(1, 6)] == [None, 1.0, 1.0, 3.0, 3.0]
    assert [b[t] for t in range(1, 6)] == [1.0, 1.0, 3.0, 3.0, None]


def test_fill_gaps_per_key_range(spark):
    df = _series(spark, [("a", 1, 1.0), ("a", 4, 4.0), ("b", 10, 1.0), ("b", 11, 2.0)])
    out = ts.fill_gaps(df, ["k"], "t")
    assert sorted((r.k, r.t) for r in out.collect()) == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 10), ("b", 11)]


def test_a_repeated_index_fails_the_plan_that_reads_it(spark):
    import pytest
    from panelwright.operators import reshape
    from panelwright.operators.arima import arima_fit
    from panelwright.operators.forecast import ets_fit
    df = _series(spark, [("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 1.0), ("b", 2, 3.0)])
    good = df.where("k = 'b'")
    value = [c for c in df.columns if c not in ("k", "t")][0]
    assert sorted(r.t for r in ts.declare_series(good, ["k"], "t").collect()) == [1, 2]
    for read in (lambda d: ts.declare_series(d, ["k"], "t"), lambda d: ts.fill_gaps(d, ["k"], "t"),
                 lambda d: arima_fit(d, ["k"], "t", value), lambda d: ets_fit(d, ["k"], "t", value),
                 lambda d: reshape.pivot_single(d, ["k"], "t", value, [1, 2])):
        read(good).collect()
        with pytest.raises(Exception, match="duplicate index|more than one row"):
            read(df).collect()


def test_the_check_of_a_series_adds_no_exchange(spark):
    df = _series(spark, [("a", 1, 1.0), ("a", 3, 2.0)])
    plan = ts.fill_gaps(df, ["k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "raise_error" in plan
