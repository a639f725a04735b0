"""Name resolution, sample CRPS and the interactive forecast on literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import names
from panelwright.plans import evaluation as ev
from panelwright.plans.interactive import interactive_forecast
from panelwright.sources.dictionaries import NAME_FIXES_UN_TO_WB, name_fixes_df


def test_accents_fold(spark):
    rows = [("Côte d'Ivoire", "cotedivoire"), ("Türkiye", "turkiye"), ("Curaçao", "curacao"), ("São Tomé and Príncipe", "saotomeandprincipe"),
            ("Åland", "aland"), ("Österreich", "osterreich"), ("Straße", "strasse"), ("Łódź", "lodz"), ("Íle", "ile"), ("Việt Nam", "vietnam"),
            ("  U.S.A. ", "usa"), ("中国", "中国"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "raw string, expected string")
    for r in df.withColumn("got", names.normalised_name("raw")).collect():
        assert r.got == r.expected, r.raw


def test_real_names_resolve_through_aliases_and_patterns(spark):
    world = sorted({c for _, c in NAME_FIXES_UN_TO_WB} | {"Spain", "Austria", "Niger", "Nigeria", "Guinea", "Guinea-Bissau", "Korea, Dem. People's Rep."})
    canonical = spark.createDataFrame([(c,) for c in world], "WB_Name string")
    asked = {"Côte d'Ivoire": ("Cote d'Ivoire", "name"), "COTE D’IVOIRE": ("Cote d'Ivoire", "name"), "Türkiye": ("Turkey", "alias"), "Curaçao": ("Curacao", "name"),
             "Viet Nam": ("Vietnam", "name"), "USA": ("United States", "alias"), "Iran (Islamic Republic of)": ("Iran, Islamic Rep.", "pattern"), "Republic of Korea": ("Korea, Rep.", "pattern"),
             "Dem. People's Republic of Korea": ("Korea, Dem. People's Rep.", "pattern"), "Republic of Moldova": (None, None),
             "The Kyrgyz Republic": ("Kyrgyz Republic", "pattern"), "Nigeria": ("Nigeria", "name"), "Atlantis": (None, None), "": (None, None), None: (None, None)}
    asked["Republic of Moldova"] = ("Moldova", "pattern") if "Moldova" in world else (None, None)
    df = spark.createDataFrame([(k, 1) for k in asked] + [("Spain", 2), ("Spain", 2)], "raw string, canonical_id int")
    out = names.resolve_names(df, "raw", canonical, "WB_Name", name_fixes_df(spark)).collect()
    assert len(out) == len(asked) + 2
    for r in out:
        assert (r.canonical, r.matched_by) == asked.get(r.raw, ("Spain", "name")), r.raw
    plan = names.resolve_names(df, "raw", canonical, "WB_Name", name_fixes_df(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sample_crps_is_the_energy_form(spark):
    rng = np.random.default_rng(1)
    draws = {("a", t): rng.normal(t, 1 + t, 30) for t in (1, 2)} | {("b", 1): np.array([2.0]), ("c", 1): np.array([3.0, 3.0])}
    paths = spark.createDataFrame([(k, "M", i, t, float(x)) for (k, t), xs in draws.items() for i, x in enumerate(xs)],
                                  "k string, model string, path int, t int, sim double")
    actual = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 4.0), ("b", 1, 5.0), ("c", 1, None), ("d", 1, 1.0)], "k string, t int, y double")
    energy = lambda xs, y: np.abs(xs - y).mean() - 0.5 * np.abs(xs[:, None] - xs[None, :]).mean()
    got = {r.k: r.CRPS for r in ev.crps_sample(paths, actual, ["k"], "t", "y").collect()}
    assert set(got) == {"a", "b"} and got["b"] == 3.0
    assert abs(got["a"] - (energy(draws["a", 1], 0.5) + energy(draws["a", 2], 4.0)) / 2) < 1e-12


def test_interactive_forecast_is_one_plan_of_the_chosen_model(spark, monkeypatch):
    from panelwright.operators import arima
    monkeypatch.setattr(arima, "arima_fit", lambda *a: (_ for _ in ()).throw(AssertionError("a model that was not chosen")))
    rows = [("a", t, float(10 + t % 3)) for t in range(2000, 2012)] + [("one", 2001, 5.0), ("gap", 2001, None), ("late", 2011, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    out = interactive_forecast(df, ["k"], "t", "y", 2001, 2008, "MEAN", 5).collect()
    assert {r.k for r in out} == {"a"}
    by = {kind: sorted((r for r in out if r.kind == kind), key=lambda r: r.t or 0) for kind in ("train", "forecast", "bridge", "accuracy")}
    assert [r.t for r in by["train"]] == list(range(2001, 2009)) and [r.t for r in by["forecast"]] == list(range(2009, 2014))
    mean = np.mean([10 + t % 3 for t in range(2001, 2009)])
    assert [(r.t, r.value) for r in by["bridge"]] == [(2008, float(10 + 2008 % 3)), (2009, mean)]
    errors = np.array([mean - (10 + t % 3) for t in (2009, 2010, 2011)])
    assert abs(by["accuracy"][0].RMSE - np.sqrt((errors ** 2).mean())) < 1e-12 and by["accuracy"][0].t is None
    assert all(r.lo95 <= r.lo80 <= r.value <= r.hi80 <= r.hi95 for r in by["forecast"])
    assert interactive_forecast(df, ["k"], "t", "y", 2001, 2008, "MEAN", 5, pick=F.col("k") == "one").collect() == []
    with pytest.raises(ValueError):
        interactive_forecast(df, ["k"], "t", "y", 2001, 2008, "PROPHET", 5)
