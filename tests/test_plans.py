"""Physical-plan properties that matter at scale (pruning, pushdown, shuffle shape)."""

from pyspark.sql import functions as F

from panelwright.operators import reshape as rs
from panelwright.operators import timeseries as ts
from panelwright.operators.aggregate import exact_quantiles
from panelwright.operators.relational import top_n_with_ties
from panelwright.sources import bindings as b


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fact_scan_is_pruned_and_partially_aggregated(spark, small_dir):
    p = _plan(b.trade_panel(spark, small_dir, materialized=False))
    scan = [line for line in p.splitlines() if "lineitem" in line and "FileScan" in line][0]
    for unused in ("l_partkey", "l_discount", "l_tax", "l_shipdate", "l_linenumber", "l_returnflag"):
        assert unused not in scan
    assert "partial_sum" in p


def test_filter_reaches_the_parquet_scan(spark, small_dir):
    df = b.table(spark, small_dir, "orders").where(F.col("o_totalprice") > 1000).select("o_orderkey")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_fill_chain_is_one_window_over_the_series_keys(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 3.0)], "k string, t int, x double")
    out = df.withColumn("y", ts.fill_chain_expr("x", ["k"], "t", final=0.0))
    opt = _optimized(out)
    assert opt.count("Window [") == 1


def test_complete_grid_has_no_cross_product(spark):
    df = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 2, "y", 2.0)], "c string, y int, v string, a double")
    p = _plan(rs.complete_grid(df, ["c", "y", "v"], fill={"a": 0.0}))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p
    assert rs.complete_grid(df, ["c", "y", "v"]).count() == 8


def test_complete_grid_keeps_null_levels_and_given_levels(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", None, 2.0), (None, 1, 3.0)], "c string, y int, a double")
    got = {(r.c, r.y, r.a) for r in rs.complete_grid(df, ["c", "y"]).collect()}
    assert got == {("a", 1, 1.0), ("a", None, 2.0), (None, 1, 3.0), (None, None, None)}
    got = {(r.c, r.y, r.a) for r in rs.complete_grid(df, ["c", "y"], levels={"y": [1, 7]}).collect()}
    assert got == {("a", 1, 1.0), ("a", 7, None), (None, 1, 3.0), (None, 7, None), ("a", None, 2.0)}


def test_global_top_n_with_ties_uses_no_single_partition_window(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 17).cast("double").alias("v"))
    out = top_n_with_ties(df, 3, "v")
    assert "Window" not in _plan(out)
    assert out.count() == 58  # the top 3 are all 16.0, which occurs 58 times: every tie is kept


def test_quantiles_use_no_percentile(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)], "k string, x double")
    q = exact_quantiles(df, ["k"], "x", (0.5,))
    plan = _plan(q).lower().replace("percentile_approx", "")        # a sketch of bounded size places the slices, no more
    assert "percentile" not in plan
    assert q.collect()[0].q == 49.5


def test_year_filter_reaches_the_orders_scan(spark, small_dir):
    import __spark_entry__ as E
    p = E.queries()["filter_compare"](spark, small_dir)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThan(o_orderdate" in p


def test_history_starts_no_forecast(spark, small_dir, monkeypatch):
    from panelwright.catalog import q_domain
    from panelwright.plans import forecast_system as fs
    monkeypatch.setattr(fs, "ModelTable", lambda *a: (_ for _ in ()).throw(AssertionError("a model is fitted")))
    assert q_domain.e1(spark, small_dir).history().columns[:2] == ["Country", "Year"]


def test_industry_value_on_series_of_unequal_length(spark):
    """History and forecast rows of one country and year: history first, at any partitioning."""
    from panelwright.plans import forecast_system as fs
    rows = [("A", y, "History", 2000.0, 10.0 * y, 5.0, 5.0) for y in range(2000, 2006)]
    rows += [("A", y, "Forecast", 2000.0, 50.0 * y, 5.0, 5.0) for y in range(2003, 2009)]
    df = spark.createDataFrame(rows, "Country string, Year int, Type string, Imports_Kg double, Import_Value double, "
                                     "Processed_Own_Waste double, Processed_Others_Waste double")
    out = [sorted(map(tuple, fs.industry_value(df.repartition(n, "Import_Value"), price_cap=1e9).collect())) for n in (1, 7)]
    assert out[0] == out[1] and len(out[0]) == 12
