"""Queries that need trade and recycling run the fact join once."""

import datetime as dt

import pytest

from panelwright.sources import bindings as b


def _write(df, path):
    df.coalesce(1).write.parquet(path)


@pytest.fixture
def own_dir(spark, tmp_path):
    d = str(tmp_path)
    day = lambda y: dt.datetime(y, 3, 1)
    lines = [(k, k % 4, float(k % 7), 10.0 * k + 0.25, "ARN"[k % 3], "FO"[k % 2]) for k in range(60)]
    lines += [(3, 1, None, None, "R", "O"), (4, None, 1.0, 5.0, "R", None), (5, 2, 1.0, 7.0, None, "F"), (None, 1, 1.0, 9.0, "A", "F")]
    _write(spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                                        "l_returnflag string, l_linestatus string"), f"{d}/lineitem.parquet")
    orders = [(k, k % 5, 100.0 + k, day(1993 + k % 3)) for k in range(60)] + [(6, 1, 1.0, day(1994)), (7, 1, 1.0, None)]
    _write(spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp"),
           f"{d}/orders.parquet")
    _write(spark.createDataFrame([(k, k % 3) for k in range(5)], "c_custkey long, c_nationkey int"), f"{d}/customer.parquet")
    _write(spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 2), (3, None)], "s_suppkey long, s_nationkey int"),
           f"{d}/supplier.parquet")
    _write(spark.createDataFrame([(0, "ALGERIA", 0), (1, "BRAZIL", 1), (2, "CHINA", None), (1, "BRAZIL", 1)],
                                 "n_nationkey int, n_name string, n_regionkey int"), f"{d}/nation.parquet")
    _write(spark.createDataFrame([(0, "AFRICA"), (1, "AMERICA")], "r_regionkey int, r_name string"), f"{d}/region.parquet")
    return d


def _rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_totals_give_the_same_panel_and_recycling(spark, own_dir):
    totals = b.nation_totals(spark, own_dir)
    assert _rows(b.trade_panel(spark, own_dir, totals=totals)) == _rows(b.trade_panel(spark, own_dir))
    assert _rows(b.recycling(spark, own_dir, totals)) == _rows(b.recycling(spark, own_dir))
    with pytest.raises(ValueError):
        b.trade_panel(spark, own_dir, years=(1993, 1994), totals=totals)


@pytest.mark.parametrize("name", ["dom_metric_long", "dom_waste_processing", "join_left_multi", "join_full_outer",
                                  "union_by_name", "dom_country_profile", "dom_waste_history"])
def test_one_fact_join(spark, small_dir, monkeypatch, name):
    from panelwright.catalog import REGISTRY
    joins, orders = [], []
    totals, gdp = b.supplier_period_totals, b.gdp
    monkeypatch.setattr(b, "supplier_period_totals", lambda *a, **k: joins.append(1) or totals(*a, **k))
    monkeypatch.setattr(b, "gdp", lambda *a, **k: orders.append(1) or gdp(*a, **k))
    REGISTRY[name].fn(spark, small_dir)
    assert len(joins) == 1 and len(orders) == 1
