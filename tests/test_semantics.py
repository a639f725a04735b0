"""R-vs-Spark semantic rules S1–S12 on literal micro-tables."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from panelwright.functions import exprs as X
from panelwright.operators import aggregate as agg
from panelwright.operators import imputation as imp
from panelwright.operators import relational as rel
from panelwright.operators import timeseries as ts


def test_if_else3_null_condition_gives_null(spark):  # S1
    df = spark.createDataFrame([(1.0,), (None,), (-1.0,)], "x double")
    out = [r.y for r in df.select(X.if_else3(F.col("x") > 0, F.lit("pos"), F.lit("neg")).alias("y")).collect()]
    assert out == ["pos", None, "neg"]


def test_sum0_all_null_is_zero(spark):  # S2
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0)], "k string, x double")
    got = {r.k: r.s for r in agg.sum_by(df, ["k"], {"s": "x"}).collect()}
    assert got == {"a": 0.0, "b": 2.0}


def test_safe_div_zero_is_null(spark):  # S3
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r.r for r in df.select(X.safe_div("a", "b").alias("r")).collect()] == [None, None, 1.5]
    fin = df.select(X.safe_div("a", "b").alias("r")).where(X.is_finite("r")).count()
    assert fin == 1


def test_pmax_keeps_null(spark):  # S4
    df = spark.createDataFrame([(None,), (-2.0,), (5.0,)], "x double")
    assert [r.y for r in df.select(X.clamp("x", 0.0, 4.0).alias("y")).collect()] == [None, 0.0, 4.0]


def test_null_safe_join(spark):  # S5
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("x", "X"), (None, "N")], "k string, w string")
    assert rel.join_lookup(a, b, "k").where("w = 'N'").count() == 0
    assert rel.join_lookup(a, b, "k", null_safe=True).where("w = 'N'").count() == 1


def test_rank_keeps_ties_row_number_does_not(spark):  # S6
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 4.0), ("d", 1.0)], "k string, v double")
    assert rel.top_n_with_ties(df, 1, "v").count() == 2
    assert rel.top_n(df, 1, [F.col("v").desc(), F.col("k")]).count() == 1
    grouped = df.withColumn("g", F.lit(1))
    assert rel.top_n_with_ties(grouped, 1, "v", partition=["g"]).count() == 2


def test_distinct_keep_first_is_deterministic(spark):  # S7
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "only")], "k string, t int, v string")
    got = {r.k: r.v for r in rel.distinct_keep_first(df, ["k"], ["t"]).collect()}
    assert got == {"a": "early", "b": "only"}


def test_round_half_even(spark):  # S8
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,)], "x double")
    assert [r.y for r in df.select(X.round_half_even("x").alias("y")).collect()] == [2.0, 4.0, -2.0]


def test_single_row_sd_is_null(spark):  # S9
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, x double")
    got = {r.k: r.s for r in agg.sd_by(df, ["k"], "x", "s").collect()}
    assert got["a"] is None and abs(got["b"] - 1.4142135623730951) < 1e-12


def test_exact_median_and_quartiles(spark):  # S10
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 4.0, 9.0)], "k string, x double")
    r = agg.box_stats(df, ["k"], "x").collect()[0]
    assert (r.q1, r.median, r.q3) == (1.75, 3.0, 5.25)
    assert agg.median_by(df, ["k"], "x", "m").collect()[0].m == 3.0


def test_trend_slope(spark):
    from panelwright.plans.evaluation import trend_slope
    df = spark.createDataFrame([("r", 1.0, 2.0), ("r", 2.0, 4.5), ("r", 3.0, 5.0)], "k string, x double, y double")
    assert abs(trend_slope(df, ["k"], "x", "y").collect()[0].Gradient - 1.5) < 1e-12


def test_kleene_or(spark):  # S12
    df = spark.createDataFrame([(None,)], "b boolean")
    r = df.select((F.col("b") | F.lit(True)).alias("t"), (F.col("b") | F.lit(False)).alias("n")).collect()[0]
    assert r.t is True and r.n is None


def test_outlier_rule_three_valued(spark):
    df = spark.createDataFrame([(1.0, None), (None, 3.0), (0.0, 4.0), (1.0, 4.0)], "Qty double, PrimaryValue double")
    out = [(r.Qty, r.PrimaryValue) for r in imp.blank_outliers(df, 5.0, 1000.0, qty_scale=1e9).collect()]
    assert out == [(None, None), (None, None), (None, None), (1.0, 4.0)]
    only_qty = [(r.Qty, r.PrimaryValue) for r in
                imp.blank_outliers(df, 5.0, 1000.0, qty_scale=1e9, blank="qty").collect()]
    assert only_qty[2] == (None, 4.0)


def test_rolling_mean_edge_extension(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 2.0, 6.0, 7.0])], "k string, t int, x double")
    out = [r.m for r in ts.roll_mean_right(df, ["k"], "t", "x", "m").orderBy("t").collect()]
    assert out == [3.0, 3.0, 3.0, 5.0]


def test_pivot_unpivot_round_trip(spark):
    from panelwright.operators.reshape import pivot_single, unpivot_long
    df = spark.createDataFrame([Row(k="a", n="x", v=1.0), Row(k="a", n="y", v=None), Row(k="b", n="x", v=3.0)])
    w = pivot_single(df, ["k"], "n", "v", ["x", "y"])
    long = unpivot_long(w, ["k"], ["x", "y"], "n", "v")
    assert long.count() == 4 and long.where("v IS NULL").count() == 2


def test_reference_dictionary_lookup_dedupes_repeated_alias(spark):
    from panelwright.sources.dictionaries import name_fixes_df
    names = spark.createDataFrame([("Viet Nam",), ("USA",), ("Spain",)], "Country string")
    out = {r.Country: r.m for r in rel.lookup_dictionary(names, name_fixes_df(spark), "Country", "m").collect()}
    assert out == {"Viet Nam": "Vietnam", "USA": "United States", "Spain": "Spain"}


def test_exact_quantiles_match_numpy_with_a_hot_key(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    hot = [("hot", float(x)) for x in rng.normal(size=3000).round(3)]
    cold = [(f"k{i % 7}", float(x)) for i, x in enumerate(rng.exponential(size=700).round(3))]
    df = spark.createDataFrame(hot + cold + [("nulls", None)], "k string, x double")
    got = {(r.k, r.p): r.q for r in agg.exact_quantiles(df, ["k"], "x", (0.1, 0.5, 0.75)).collect()}
    few = {(r.k, r.p): r.q for r in agg.exact_quantiles(df, ["k"], "x", (0.1, 0.5, 0.75), buckets=3).collect()}
    assert few == got
    by = {}
    for k, x in hot + cold:
        by.setdefault(k, []).append(x)
    for k, xs in by.items():
        for p in (0.1, 0.5, 0.75):
            assert abs(got[(k, p)] - float(np.quantile(xs, p))) < 1e-9
    med = {r.k: r.m for r in agg.median_by(df, ["k"], "x", "m").collect()}
    assert med["nulls"] is None and abs(med["hot"] - float(np.median(by["hot"]))) < 1e-12


def test_quantiles_of_repeats_nan_nulls_and_extremes(spark):
    rows = [("rep", 7.0)] * 100_000 + [("rep", 1.0), ("nan", float("nan")), ("nan", 2.0), ("nan", 4.0), ("none", None),
                                        (None, 5.0), ("wide", -1e300), ("wide", 0.0), ("wide", 1e300), ("inf", float("inf")), ("inf", 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: r.m for r in agg.median_by(df, ["k"], "x", "m").collect()}
    assert got == {"rep": 7.0, "nan": 3.0, "none": None, None: 5.0, "wide": 0.0, "inf": float("inf")}


def _squeezed(n=20_000):
    """Values within a hundredth of each other, one far out, one very far out."""
    import numpy as np
    return [1.0 + float(x) / 100 for x in np.random.default_rng(2).random(n)] + [1e12, 1e300, -1e300]


def test_quantiles_and_ranks_spread_whatever_the_range(spark):
    import numpy as np
    from panelwright.plans.evaluation import rank_all
    xs = _squeezed()
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 1.0)], "k string, x double").repartition(6)
    sizes = agg.sliced_counts(df, ["k"], F.col("x")).where("_k.k = 'a'").groupBy("_b").count()
    assert sizes.count() > 200 and sizes.agg(F.max("count")).collect()[0][0] < 0.02 * len(xs)
    got = {(r.k, r.p): r.q for r in agg.exact_quantiles(df, ["k"], "x", (0.0, 0.25, 0.5, 1.0)).collect()}
    for p in (0.0, 0.25, 0.5, 1.0):
        assert got["a", p] == float(np.quantile(xs, p)) and got["b", p] == 1.0
    ranks = {r.x: r["rank"] for r in rank_all(df.where("k = 'a'"), "x").collect()}
    assert ranks == {x: i + 1 for i, x in enumerate(sorted(xs))}


def test_ranks_of_many_ties_are_one_row_per_value(spark):
    from panelwright.plans.evaluation import rank_all
    df = spark.range(30_000).select((F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double"))).alias("x"))
    out = rank_all(df, "x", descending=True)
    assert out.where("x = 5.0").select("rank").distinct().collect()[0][0] == out.where("x > 5.0").count() + 1
    odd = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("inf"),), (None,), (-1.0,)], "x double")
    up = sorted(r["rank"] for r in rank_all(odd, "x").collect())
    assert up == [1, 2, 2, 4, 5, 6]
    assert {str(r.x): r["rank"] for r in rank_all(odd, "x", descending=True).collect()} == {"inf": 1, "0.0": 2, "-0.0": 2, "-1.0": 4, "nan": 5, "None": 6}


def test_rank_all_matches_a_window(spark):
    from panelwright.plans.evaluation import rank_all
    xs = [3.0, 1.0, 2.0, 2.0, None, -5.0, 1e9, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for desc in (False, True):
        got = {r.i: r["rank"] for r in rank_all(df, "x", descending=desc, slices=4).collect()}
        val = [x for x in xs if x is not None]
        want = {i: (len(val) if x is None else sum(v > x if desc else v < x for v in val)) + 1 for i, x in enumerate(xs)}
        assert got == want
    assert rank_all(df.limit(0), "x").collect() == []


def test_ets_keeps_short_series(spark):
    from panelwright.operators import forecast as fc
    rows = [(f"n{n}", i, float(i * i + 1)) for n in (1, 2, 3, 4, 5, 9) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, x double")
    out = fc.fc_ets(df, ["k"], "i", "x", 3).collect()
    assert len(out) == 18 and all(r["mean"] is not None for r in out)
    assert {r.k for r in out if r.variance is None} == {"n1"}
