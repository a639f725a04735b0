"""§2.9 forecasting queries (monthly trade series; annual panel for bottom-up)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import clamp as clamp_expr
from ..functions.exprs import std_normal
from ..operators import forecast as fc
from ..operators import timeseries as ts
from ..operators.arima import arima_paths, fc_arima
from ..plans import evaluation as ev
from ..plans.interactive import interactive_forecast
from ..plans.model_table import ModelTable
from ..session import cut_lineage
from ..sources import bindings as b
from . import sqlfrag as sf
from .common import waste
from .registry import query
from .sqlbind import register, with_ctes

KEYS = ["Country", "flowDesc"]
IDX = "Year"
H = 4
FC_D = {"mean": 6, "variance": 4}

# --- series -------------------------------------------------------------------------

register("series_m", f"""
SELECT Country, flowDesc, Year, {sf.chain('Qty', KEYS, IDX, final=0.0)} AS Qty FROM trade_m_filled""",
         ("trade_m_filled",))
register("train_m", "SELECT * FROM series_m WHERE Year <= (SELECT max(Year) FROM series_m) - 4", ("series_m",))
register("test_m", "SELECT * FROM series_m WHERE Year > (SELECT max(Year) FROM series_m) - 4", ("series_m",))


def series_m(spark, sf_dir):
    """Monthly quantity series per (country, flow), gaps filled by the chain.

    This is the model-input table every forecast reads several times (train,
    test, one pass per model), so it is written once to the checkpoint folder
    instead of re-deriving it from the fact join in every branch.
    """
    t = b.trade_panel(spark, sf_dir, monthly=True, materialized=False)
    return cut_lineage(ts.fill_chain(t, KEYS, IDX, "Qty", final=0.0).select(*KEYS, IDX, "Qty"))


def split_m(spark, sf_dir, series=None):
    return fc.split_relative(series if series is not None else series_m(spark, sf_dir), IDX, 4)


# --- SQL of the models ----------------------------------------------------------------

def _sql_mean(src, keys, h, value="Qty"):
    k = ", ".join(keys)
    return f"""
SELECT {k}, 'MEAN' AS model, CAST(unnest(generate_series(last + 1, last + {h})) AS INTEGER) AS Year,
       m AS mean, s2 * (1.0 + 1.0 / n) AS variance
FROM (SELECT {k}, avg({value}) AS m, var_samp({value}) AS s2, count({value}) AS n, max(Year) AS last
      FROM {src} GROUP BY {k})"""


def _sql_naive(src, keys, h, value="Qty"):
    k = ", ".join(keys)
    return f"""
SELECT {k}, 'NAIVE' AS model, Year, y AS mean, s2 * (Year - last) AS variance FROM (
  SELECT *, CAST(unnest(generate_series(last + 1, last + {h})) AS INTEGER) AS Year FROM (
    SELECT {k}, arg_max({value}, Year) AS y, avg(e * e) AS s2, max(Year) AS last
    FROM (SELECT *, {value} - lag({value}) OVER (PARTITION BY {k} ORDER BY Year) AS e FROM {src})
    GROUP BY {k}))"""


def _sql_ets(src, keys, h, value="Qty"):
    k = ", ".join(keys)
    points = {t: "[" + ", ".join(f"{{'alpha': {a!r}::DOUBLE, 'beta': {bb!r}::DOUBLE, 'phi': {p!r}::DOUBLE}}" for f, a, bb, p in fc.ets_grid() if f == t) + "]"
              for t in fc.ETS_TRENDS}
    z = "0.0::DOUBLE"
    g0 = "CASE WHEN trend = 'NN' THEN 0.0 ELSE q.phi * (y[2] - y[1]) END"
    aicc = ("CASE WHEN err = 'M' THEN CASE WHEN s.ok THEN m * ln(greatest(s.rse, 1e-12) / nullif(m, 0)) + 2 * s.lf END ELSE m * ln(greatest(s.sse, 1e-12) / nullif(m, 0)) END "
            "+ 2 * k + CASE WHEN m - k - 1 > 0 THEN 2 * k * (k + 1) / (m - k - 1) END")
    rel = "CASE WHEN err = 'M' AND s.ok AND s.f > 0 THEN {e} ELSE 0.0 END"
    run = (f"list_reduce(y[2:], lambda s, x: {{'f': s.f + q.alpha * (x - s.f) + q.phi * (s.g + q.beta * (x - s.f)), 'g': q.phi * (s.g + q.beta * (x - s.f)), "
           f"'sse': s.sse + (x - s.f) * (x - s.f), 'rse': s.rse + {rel.format(e='(x - s.f) / s.f * ((x - s.f) / s.f)')}, "
           f"'lf': s.lf + {rel.format(e='ln(CASE WHEN s.f > 0 THEN s.f END)')}, 'ok': s.ok AND s.f > 0 AND x > 0}}, "
           f"{{'f': y[1] + {g0}, 'g': ({g0})::DOUBLE, 'sse': {z}, 'rse': {z}, 'lf': {z}, 'ok': y[1] > 0}})")
    score = (f"list_transform([{run}], lambda s: {{'a': coalesce(round({aicc}, 9), 1e300), 'z': CASE WHEN m - k - 1 > 0 THEN 0.0 ELSE s.sse END, "
             "'alpha': q.alpha, 'beta': q.beta, 'phi': q.phi, 'f': s.f, 'g': s.g, 'ss': CASE WHEN err = 'M' THEN s.rse ELSE s.sse END})[1]")
    (a0, a1), (b0, _), (p0, p1) = fc.ETS_BOUNDS.values()
    moves = ", ".join(f"{{'a': {da}, 'b': {db}, 'p': {dp}}}" for da, db, dp in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
    alpha = f"least(greatest(b.alpha + v.a * 0.1::DOUBLE * pow(0.5, j), {a0}::DOUBLE), {a1}::DOUBLE)"
    moved = (f"list_transform(list_filter([{moves}], lambda v: trend = 'AdN' OR (v.p = 0 AND (trend = 'AN' OR v.b = 0))), lambda v: {{'alpha': {alpha}, "
             f"'beta': CASE WHEN trend = 'NN' THEN 0.0 ELSE least(greatest(b.beta + v.b * 0.1::DOUBLE * pow(0.5, j), {b0}::DOUBLE), {alpha}) END, "
             f"'phi': CASE WHEN trend = 'AdN' THEN least(greatest(b.phi + v.p * 0.1::DOUBLE * pow(0.5, j), {p0}::DOUBLE), {p1}::DOUBLE) ELSE 1.0 END}})")
    total = "CASE WHEN phi = 1 THEN {j} * 1.0 ELSE phi * (1 - pow(phi, {j})) / (1 - phi) END"
    weight = f"pow(alpha + beta * {total.format(j='i')}, 2)"
    mean = f"(level + {total.format(j='j')} * slope)"
    theta = (f"list_reduce(range(1, {h} + 1), lambda t, j: list_append(t, {mean} * {mean} + sigma2 * coalesce(list_sum(list_transform(range(1, j), "
             f"lambda i: {weight} * t[j - i])), 0.0)), []::DOUBLE[])")
    return f"""
SELECT {k}, 'ETS' AS model, (last + x.j)::INTEGER AS Year, x.mean, x.variance FROM (
  SELECT {k}, last, unnest(list_transform(range(1, {h} + 1), lambda j: {{'j': j, 'mean': {mean}, 'variance': CASE WHEN err = 'M'
           THEN greatest((1 + sigma2) * theta[j] - {mean} * {mean}, 0.0)
           ELSE sigma2 * (1 + coalesce(list_sum(list_transform(range(1, j), lambda i: {weight})), 0.0)) END}})) AS x FROM (
    SELECT *, CASE WHEN err = 'M' THEN {theta} END AS theta FROM (
      SELECT {k}, last, err, best.alpha AS alpha, best.beta AS beta, best.phi AS phi, best.f - best.g AS level, best.g / best.phi AS slope,
             best.ss / CASE WHEN m - k > 0 THEN m - k ELSE nullif(m, 0) END AS sigma2 FROM (
        SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY best.a, k, err, best.z, best.alpha, best.beta, best.phi) AS rn FROM (
          SELECT * EXCLUDE (start), list_reduce(range(1, {fc.ETS_HALVINGS} + 1), lambda b, j:
              list_sort(list_concat([b], list_transform({moved}, lambda q: {score})))[1], start) AS best FROM (
            SELECT *, list_sort(list_transform(CASE trend {" ".join(f"WHEN '{t}' THEN {x}" for t, x in points.items())} END, lambda q: {score}))[1] AS start FROM (
              SELECT s.*, (n - 1)::DOUBLE AS m, g.* FROM (
                SELECT {k}, list({value}::DOUBLE ORDER BY Year) AS y, count(*) AS n, max(Year) AS last FROM {src} GROUP BY {k}) s,
                (VALUES {", ".join(f"('{e}', '{t}', {n})" for e in "AM" for t, n in fc.ETS_TRENDS.items())}) g(err, trend, k)
              WHERE g.err = 'A' OR list_min(s.y) > 0))))
      WHERE rn = 1)))"""


def _sql_ar1(src, keys, h, value="Qty"):
    k = ", ".join(keys)
    geo = "CASE WHEN abs(phi - 1.0) < 1e-12 THEN kk ELSE (1.0 - pow(phi, kk)) / (1.0 - phi) END"
    geo2 = "CASE WHEN abs(phi * phi - 1.0) < 1e-12 THEN kk ELSE (1.0 - pow(phi, 2.0 * kk)) / (1.0 - phi * phi) END"
    return f"""
SELECT {k}, 'AR1' AS model, Year, c * {geo} + pow(phi, kk) * y AS mean, sigma2 * {geo2} AS variance FROM (
  SELECT *, CAST(Year - last AS DOUBLE) AS kk FROM (
    SELECT *, CAST(unnest(generate_series(last + 1, last + {h})) AS INTEGER) AS Year FROM (
      SELECT *, CASE WHEN m > 2 THEN greatest(syy - phi * sxy, 0.0) / (m - 2) END AS sigma2 FROM (
        SELECT {k}, regr_slope({value}, lg) AS phi, regr_intercept({value}, lg) AS c, regr_count({value}, lg) AS m,
               regr_syy({value}, lg) AS syy, regr_sxy({value}, lg) AS sxy, arg_max({value}, Year) AS y, max(Year) AS last
        FROM (SELECT *, lag({value}) OVER (PARTITION BY {k} ORDER BY Year) AS lg FROM {src}) GROUP BY {k}))))"""


register("fcm_mean", _sql_mean("train_m", KEYS, H), ("train_m",))
register("fcm_naive", _sql_naive("train_m", KEYS, H), ("train_m",))
register("fcm_ets", _sql_ets("train_m", KEYS, H), ("train_m",))
register("fit_arima", sf.arima_fit("train_m", KEYS, "Qty"), ("train_m",))
register("fit_arima_full", sf.arima_fit("series_m", KEYS, "Qty"), ("series_m",))
register("fcm_arima", sf.arima_forecast("fit_arima", KEYS, H), ("fit_arima",))
register("fcm_ar1", _sql_ar1("train_m", KEYS, H), ("train_m",))
register("fcm_all", """SELECT * FROM fcm_mean UNION ALL SELECT * FROM fcm_naive UNION ALL SELECT * FROM fcm_ets
UNION ALL SELECT Country, flowDesc, model, Year, mean, variance FROM fcm_arima""",
         ("fcm_mean", "fcm_naive", "fcm_ets", "fcm_arima"))
register("fcm_act", """
SELECT f.*, t.Qty AS actual FROM fcm_all f LEFT JOIN test_m t
  ON f.Country = t.Country AND f.flowDesc = t.flowDesc AND f.Year = t.Year""", ("fcm_all", "test_m"))
register("fcm_acc", """
SELECT Country, flowDesc, model, sqrt(avg((mean - actual) * (mean - actual))) AS RMSE, avg(abs(mean - actual)) AS MAE,
       avg(abs((mean - actual) / nullif(actual, 0))) * 100 AS MAPE
FROM fcm_act WHERE actual IS NOT NULL GROUP BY 1, 2, 3""", ("fcm_act",))


def _models(train, h=H):
    """MEAN, NAIVE, ETS and ARIMA forecasts under one model column."""
    fits = [f(train, KEYS, IDX, "Qty", h) for f in (fc.fc_mean, fc.fc_naive, fc.fc_ets, fc_arima)]
    out = fits[0]
    for f in fits[1:]:
        out = out.unionByName(f.select(*out.columns))
    return out


def models_m(spark, sf_dir, h=H):
    train, _ = split_m(spark, sf_dir)
    return _models(train, h)


def with_actual_m(spark, sf_dir):
    train, test = split_m(spark, sf_dir)
    return ev.with_actual(_models(train), test, KEYS, IDX, "Qty")


def accuracy_m(spark, sf_dir):
    return ev.accuracy(with_actual_m(spark, sf_dir), [*KEYS, "model"])


# --- models -----------------------------------------------------------------------------

@query("fc_mean", with_ctes("SELECT * FROM fcm_mean", "fcm_mean"), doubles=FC_D)
def q_fc_mean(spark, sf_dir):
    """Mean model per series: mean, variance σ²(1 + 1/n)."""
    train, _ = split_m(spark, sf_dir)
    return fc.fc_mean(train, KEYS, IDX, "Qty", H)


@query("fc_naive", with_ctes("SELECT * FROM fcm_naive", "fcm_naive"), doubles=FC_D)
def q_fc_naive(spark, sf_dir):
    """Naive (random walk) per series: last value, variance h·σ²."""
    train, _ = split_m(spark, sf_dir)
    return fc.fc_naive(train, KEYS, IDX, "Qty", H)


@query("fc_ets", with_ctes("SELECT * FROM fcm_ets", "fcm_ets"), doubles=FC_D)
def q_fc_ets(spark, sf_dir):
    """Automatic ETS: additive or multiplicative errors, no / additive / damped trend, continuous parameters, minimum AICc."""
    train, _ = split_m(spark, sf_dir)
    return fc.fc_ets(train, KEYS, IDX, "Qty", H)


@query("fc_arima_ar1", with_ctes("SELECT * FROM fcm_ar1", "fcm_ar1"), doubles=FC_D)
def q_fc_arima_ar1(spark, sf_dir):
    """AR(1) with constant by conditional least squares (regr_slope / regr_intercept)."""
    train, _ = split_m(spark, sf_dir)
    return fc.fc_ar1(train, KEYS, IDX, "Qty", H)


ARIMA_D = {"mean": "sig7", "variance": "sig6", "aicc": 4}


@query("fc_arima", with_ctes("SELECT * FROM fcm_arima", "fcm_arima"), doubles=ARIMA_D)
def q_fc_arima(spark, sf_dir):
    """Automatic ARIMA: d ≤ 2 by KPSS, AR and MA orders up to 3 with or without constant by AICc."""
    train, _ = split_m(spark, sf_dir)
    return fc_arima(train, KEYS, IDX, "Qty", H)


MENU = {"MEAN": fc.fc_mean, "NAIVE": fc.fc_naive, "ETS": fc.fc_ets, "ARIMA": fc_arima, "AR1": fc.fc_ar1}


def model_menu(choice: str):
    if choice not in MENU:
        raise ValueError(f"model must be one of {sorted(MENU)}")
    return MENU[choice]


@query("fc_model_menu", with_ctes("SELECT * FROM fcm_all UNION ALL SELECT * FROM fcm_ar1", "fcm_all", "fcm_ar1"), doubles=FC_D)
def q_fc_model_menu(spark, sf_dir):
    """User-picked model (parameter → branch): every branch in turn, told
    apart by the model column."""
    train, _ = split_m(spark, sf_dir)
    cols = [*KEYS, "model", IDX, "mean", "variance"]
    picks = [model_menu(m)(train, KEYS, IDX, "Qty", H).select(*cols) for m in MENU]
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out


@query("fc_multi_model", with_ctes("SELECT * FROM fcm_all", "fcm_all"), doubles=FC_D)
def q_fc_multi_model(spark, sf_dir):
    """MEAN, NAIVE, ETS and ARIMA side by side per series (one model column)."""
    return models_m(spark, sf_dir)


@query("fc_horizon", with_ctes(_sql_mean("series_m", KEYS, 10), "series_m"), doubles=FC_D)
def q_fc_horizon(spark, sf_dir):
    """h-step table per series: h = 10 from the last observation."""
    return fc.fc_mean(series_m(spark, sf_dir), KEYS, IDX, "Qty", 10)


@query("fc_intervals", with_ctes("""
SELECT *, mean - 1.28 * sqrt(variance) AS lo80, mean + 1.28 * sqrt(variance) AS hi80,
       mean - 1.96 * sqrt(variance) AS lo95, mean + 1.96 * sqrt(variance) AS hi95 FROM fcm_all""", "fcm_all"),
       doubles={**FC_D, "lo80": 4, "hi80": 4, "lo95": 4, "hi95": 4})
def q_fc_intervals(spark, sf_dir):
    """80 % and 95 % interval bounds (1.28 / 1.96 × sd)."""
    return fc.intervals(models_m(spark, sf_dir))


PATHS, PATH_H, SEED = 5, 20, 123


def _paths_sql(model):
    return with_ctes(sf.residual_paths("series_m", KEYS, "Qty", IDX, PATH_H, PATHS, SEED, model), "series_m")


@query("fc_bootstrap_paths", _paths_sql("NAIVE"), doubles={"sim": 4})
def q_fc_bootstrap_paths(spark, sf_dir):
    """Scenario table key × path × step for the naive model: residuals drawn
    by md5(key, path, step, seed) — independent of partitioning and retries."""
    return fc.residual_paths(series_m(spark, sf_dir), KEYS, IDX, "Qty", PATH_H, PATHS, SEED, "NAIVE")


@query("fc_bootstrap_mean_paths", _paths_sql("MEAN"), doubles={"sim": 4})
def q_fc_bootstrap_mean_paths(spark, sf_dir):
    """Same scenario table for the mean model (mean + one drawn residual)."""
    return fc.residual_paths(series_m(spark, sf_dir), KEYS, IDX, "Qty", PATH_H, PATHS, SEED, "MEAN")


@query("fc_bootstrap_arima", with_ctes(sf.arima_paths("fit_arima_full", KEYS, PATH_H, 1, SEED), "fit_arima_full"),
       doubles={"sim": "sig6"})
def q_fc_bootstrap_arima(spark, sf_dir):
    """Bootstrap future of the automatic ARIMA (h = 20, one path), seeded per series."""
    return arima_paths(series_m(spark, sf_dir), KEYS, IDX, "Qty", PATH_H, 1, SEED)


NOISE_SEED = 7


def add_noise(paths, hist, keys, index, seed=NOISE_SEED, share=0.10):
    """sim + N(0, share × historical sd); sd NULL/0 → 0.001; clamp at 0."""
    sd = hist.groupBy(*keys).agg(F.stddev_samp("Qty").alias("hist_sd"))
    j = paths.join(sd, on=list(keys), how="left")
    hsd = F.when(F.col("hist_sd").isNull() | (F.col("hist_sd") == 0), F.lit(0.001)).otherwise(F.col("hist_sd"))
    z = std_normal(*[F.col(k) for k in keys], F.col("path"), F.col(index), seed=seed)
    return j.withColumn("noise_sd", hsd * share).withColumn(
        "Amount", clamp_expr(F.col("sim") + z * F.col("noise_sd"), lo=0.0))


_Z = sf.std_normal("p.Country, p.flowDesc, CAST(p.path AS VARCHAR), CAST(p.Year AS VARCHAR)", NOISE_SEED)


@query("fc_noise", with_ctes(f"""
SELECT Country, flowDesc, path, Year, sim, hist_sd, noise_sd,
       CASE WHEN sim + z * noise_sd IS NOT NULL THEN greatest(sim + z * noise_sd, 0.0) END AS Amount FROM (
  SELECT p.*, s.hist_sd, CASE WHEN s.hist_sd IS NULL OR s.hist_sd = 0 THEN 0.001 ELSE s.hist_sd END * 0.1 AS noise_sd,
         {_Z} AS z
  FROM ({sf.residual_paths("series_m", KEYS, "Qty", IDX, PATH_H, PATHS, SEED, "NAIVE")}) p
  LEFT JOIN (SELECT Country, flowDesc, stddev_samp(Qty) AS hist_sd FROM series_m GROUP BY 1, 2) s
    ON p.Country = s.Country AND p.flowDesc = s.flowDesc)""", "series_m"),
       doubles={"sim": 4, "hist_sd": 4, "noise_sd": 4, "Amount": 4})
def q_fc_noise(spark, sf_dir):
    """Extra Gaussian noise (10 % of the historical sd) on the scenario paths, clamped at 0."""
    s = series_m(spark, sf_dir)
    paths = fc.residual_paths(s, KEYS, IDX, "Qty", PATH_H, PATHS, SEED, "NAIVE")  # s is checkpointed
    return add_noise(paths, s, KEYS, IDX).select(*KEYS, "path", IDX, "sim", "hist_sd", "noise_sd", "Amount")


# --- splits ------------------------------------------------------------------------------

@query("fc_split_relative", with_ctes("""
SELECT *, CASE WHEN Year <= (SELECT max(Year) FROM series_m) - 4 THEN 'train' ELSE 'test' END AS split
FROM series_m""", "series_m"), doubles={"Qty": 6})
def q_fc_split_relative(spark, sf_dir):
    """Train = all but the last 4 periods of the panel (panel-wide cut)."""
    train, test = split_m(spark, sf_dir)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


CUT_ABS = 2000 * 12 + 1


@query("fc_split_absolute", with_ctes(f"""
SELECT *, CASE WHEN Year <= {CUT_ABS} THEN 'train' ELSE 'test' END AS split FROM series_m""", "series_m"),
       doubles={"Qty": 6})
def q_fc_split_absolute(spark, sf_dir):
    """Train ≤ a fixed period (January 2000), test after."""
    train, test = fc.split_absolute(series_m(spark, sf_dir), IDX, CUT_ABS)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("fc_split_range", with_ctes("""
SELECT * EXCLUDE (n) FROM (
  SELECT *, count(*) OVER (PARTITION BY Country, flowDesc) AS n FROM series_m
  WHERE Year BETWEEN 1997 * 12 + 1 AND 1999 * 12 + 12) WHERE n >= 2""", "series_m"), doubles={"Qty": 6})
def q_fc_split_range(spark, sf_dir):
    """Training window [1997-01, 1999-12]; a series needs more than one row."""
    return fc.split_range(series_m(spark, sf_dir), KEYS, IDX, 1997 * 12 + 1, 1999 * 12 + 12, 2)


# --- evaluation --------------------------------------------------------------------------

ACC_D = {"RMSE": 4, "MAE": 4, "MAPE": 6}


@query("fc_accuracy", with_ctes("SELECT * FROM fcm_acc", "fcm_acc"), doubles=ACC_D)
def q_fc_accuracy(spark, sf_dir):
    """RMSE, MAE, MAPE per series × model on the 4-period hold-out."""
    return accuracy_m(spark, sf_dir)


@query("fc_pct_error", with_ctes("""
SELECT *, mean - actual AS error, abs((mean - actual) / nullif(actual, 0)) * 100 AS ape FROM fcm_act""", "fcm_act"),
       doubles={**FC_D, "actual": 6, "error": 4, "ape": 6})
def q_fc_pct_error(spark, sf_dir):
    """Signed error and absolute percentage error per forecast row."""
    return ev.pct_error(with_actual_m(spark, sf_dir))


@query("fc_crps", with_ctes("""
SELECT Country, flowDesc, model, avg(sd * (z * (2 * cdf - 1) + 2 * pdf - 0.5641895835477563)) AS CRPS FROM (
  SELECT *, CASE WHEN z >= 0 THEN up ELSE 1.0 - up END AS cdf FROM (
    SELECT *, 1.0 - pdfa * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
             AS up FROM (
      SELECT *, 1.0 / (1.0 + 0.2316419 * abs(z)) AS t, 0.3989422804014327 * exp(-0.5 * abs(z) * abs(z)) AS pdfa,
             0.3989422804014327 * exp(-0.5 * z * z) AS pdf FROM (
        SELECT *, sqrt(variance) AS sd, (actual - mean) / nullif(sqrt(variance), 0) AS z
        FROM fcm_act WHERE actual IS NOT NULL))))
GROUP BY 1, 2, 3""", "fcm_act"), doubles={"CRPS": 4})
def q_fc_crps(spark, sf_dir):
    """Mean CRPS of the normal forecast distribution per series × model."""
    return ev.crps_normal(with_actual_m(spark, sf_dir), [*KEYS, "model"])


CRPS_PATHS = 41      # a prime: means of draws do not end on a rounding tie


def _crps_paths_sql():
    """Energy form, stated directly: mean |X − y| − ½ mean |X − X'|."""
    parts = [f"SELECT Country, flowDesc, '{m}' AS model, Year, sim FROM ({sql})" for m, sql in (
        ("MEAN", sf.residual_paths("train_m", KEYS, "Qty", IDX, H, CRPS_PATHS, SEED, "MEAN")),
        ("NAIVE", sf.residual_paths("train_m", KEYS, "Qty", IDX, H, CRPS_PATHS, SEED, "NAIVE")),
        ("ARIMA", sf.arima_paths("fit_arima", KEYS, H, CRPS_PATHS, SEED)))]
    return f"""
SELECT Country, flowDesc, model, avg(crps) AS CRPS FROM (
  SELECT Country, flowDesc, model, Year,
         list_avg(list_transform(xs, lambda x: abs(x - y))) - 0.5 * list_avg(list_transform(xs, lambda a: list_avg(list_transform(xs, lambda b: abs(a - b))))) AS crps
  FROM (SELECT p.Country, p.flowDesc, p.model, p.Year, list(p.sim) AS xs, any_value(t.Qty) AS y FROM ({" UNION ALL ".join(parts)}) p
        JOIN test_m t ON p.Country = t.Country AND p.flowDesc = t.flowDesc AND p.Year = t.Year WHERE t.Qty IS NOT NULL GROUP BY 1, 2, 3, 4))
GROUP BY 1, 2, 3"""


@query("fc_crps_paths", with_ctes(_crps_paths_sql(), "train_m", "test_m", "fit_arima"), doubles={"CRPS": 6})
def q_fc_crps_paths(spark, sf_dir):
    """Mean CRPS of simulated distributions (bootstrap paths of MEAN, NAIVE and
    ARIMA, from stored fits) against the hold-out, in sorted-sample form."""
    train, test = split_m(spark, sf_dir)
    table = ModelTable(train, KEYS, IDX, "Qty")
    paths = None
    for m in ("MEAN", "NAIVE", "ARIMA"):
        one = table.paths(m, H, CRPS_PATHS, SEED).withColumn("model", F.lit(m))
        paths = one if paths is None else paths.unionByName(one)
    return ev.crps_sample(paths, test, KEYS, IDX, "Qty")


@query("fc_error_summary", with_ctes("""
SELECT model, avg(RMSE) AS mean_RMSE, median(RMSE) AS median_RMSE, avg(MAE) AS mean_MAE, median(MAE) AS median_MAE,
       avg(MAPE) AS mean_MAPE, median(MAPE) AS median_MAPE FROM fcm_acc GROUP BY model""", "fcm_acc"),
       doubles={f"{a}_{m}": (6 if m == "MAPE" else 4) for a in ("mean", "median") for m in ("RMSE", "MAE", "MAPE")})
def q_fc_error_summary(spark, sf_dir):
    """Mean and median of the accuracy metrics over series, per model.  The
    accuracy table (one row per series and model) is written once, so the
    models are fitted once."""
    return ev.error_summary(cut_lineage(accuracy_m(spark, sf_dir)))


@query("agg_mean_median_errors", with_ctes("""
SELECT flowDesc, model, avg(MAPE) AS mean_MAPE, median(MAPE) AS median_MAPE FROM fcm_acc GROUP BY 1, 2""", "fcm_acc"),
       doubles={"mean_MAPE": 6, "median_MAPE": 6})
def q_agg_mean_median_errors(spark, sf_dir):
    """Mean and median MAPE per flow and model."""
    return ev.error_summary(cut_lineage(accuracy_m(spark, sf_dir)), ["flowDesc", "model"], ["MAPE"])


@query("fc_divergence", with_ctes("""
SELECT *, CAST(rank() OVER (ORDER BY round(divergence, 6) DESC) AS INTEGER) AS rank FROM (
  SELECT Country, flowDesc, mape_a, mape_b, abs(mape_a - mape_b) AS divergence FROM (
    SELECT Country, flowDesc, max(CASE WHEN model = 'ARIMA' THEN MAPE END) AS mape_a,
           max(CASE WHEN model = 'ETS' THEN MAPE END) AS mape_b
    FROM fcm_acc WHERE model IN ('ARIMA', 'ETS') GROUP BY 1, 2))
WHERE divergence IS NOT NULL""", "fcm_acc"), doubles={"mape_a": 6, "mape_b": 6, "divergence": 6})
def q_fc_divergence(spark, sf_dir):
    """Per-series |MAPE_ARIMA − MAPE_ETS| and its rank (1 = largest)."""
    return ev.divergence(cut_lineage(accuracy_m(spark, sf_dir)), KEYS, "ARIMA", "ETS")


REFIT_H = 10


@query("fc_refit_full", with_ctes(" UNION ALL ".join([
    _sql_mean("series_m", KEYS, REFIT_H), _sql_naive("series_m", KEYS, REFIT_H), _sql_ets("series_m", KEYS, REFIT_H),
    f"SELECT Country, flowDesc, model, Year, mean, variance FROM ({sf.arima_forecast('fit_arima_full', KEYS, REFIT_H)})"]),
    "series_m", "fit_arima_full"), doubles={"mean": "sig7", "variance": "sig6"})
def q_fc_refit_full(spark, sf_dir):
    """The compared models refitted on all data, 10 steps ahead, from a stored model table."""
    return ModelTable(series_m(spark, sf_dir), KEYS, IDX, "Qty").forecast(REFIT_H)


@query("jump_off_point", with_ctes("""
SELECT f.Country, f.flowDesc, f.first_fc, s.Qty AS jump_off
FROM (SELECT Country, flowDesc, min(Year) AS first_fc FROM fcm_mean GROUP BY 1, 2) f
LEFT JOIN series_m s ON f.Country = s.Country AND f.flowDesc = s.flowDesc AND s.Year = f.first_fc - 1""",
    "fcm_mean", "series_m"), doubles={"jump_off": 6})
def q_jump_off_point(spark, sf_dir):
    """Actual value at (first forecast period − 1) per series."""
    series = series_m(spark, sf_dir)
    train, _ = split_m(spark, sf_dir, series)
    f = fc.fc_mean(train, KEYS, IDX, "Qty", H).groupBy(*KEYS).agg(F.min(IDX).alias("first_fc"))
    s = series.select(*KEYS, (F.col(IDX) + 1).alias("first_fc"), F.col("Qty").alias("jump_off"))
    return f.join(s, on=[*KEYS, "first_fc"], how="left")


@query("bridge_rows", with_ctes("""
SELECT Country, flowDesc, max(Year) AS Year, arg_max(Qty, Year) AS value, 'actual' AS kind FROM train_m GROUP BY 1, 2
UNION ALL
SELECT Country, flowDesc, min(Year), arg_min(mean, Year), 'forecast' FROM fcm_mean GROUP BY 1, 2""",
    "train_m", "fcm_mean"), doubles={"value": 6})
def q_bridge_rows(spark, sf_dir):
    """Last actual and first forecast as a two-row segment per series."""
    train, _ = split_m(spark, sf_dir)
    last = train.groupBy(*KEYS).agg(F.max(IDX).alias(IDX), F.max_by("Qty", IDX).alias("value")) \
        .withColumn("kind", F.lit("actual"))
    first = fc.fc_mean(train, KEYS, IDX, "Qty", H).groupBy(*KEYS).agg(
        F.min(IDX).alias(IDX), F.min_by("mean", IDX).alias("value")).withColumn("kind", F.lit("forecast"))
    return last.unionByName(first)


# --- bottom-up approaches on the annual panel ---------------------------------------------

CUT_YEAR = 1999
HB = 2
WVARS = ["Est_Waste_Produced", "Regional_Recycling_Rate", "Exports", "Imports", "Est_Recycled_Amount"]

register("wl", """
SELECT Country, Year, Variable, Amount FROM (SELECT Country, Year, """ + ", ".join(WVARS) + """ FROM waste)
UNPIVOT INCLUDE NULLS (Amount FOR Variable IN (""" + ", ".join(WVARS) + "))", ("waste",))
register("wl_train", f"SELECT * FROM wl WHERE Year <= {CUT_YEAR}", ("wl",))
register("wl_test", f"SELECT * FROM wl WHERE Year > {CUT_YEAR}", ("wl",))
register("fit_arima_w", sf.arima_fit("wl_train", ["Country", "Variable"], "Amount"), ("wl_train",))
register("wfc", _sql_mean("wl_train", ["Country", "Variable"], HB, "Amount")
         + " UNION ALL " + _sql_naive("wl_train", ["Country", "Variable"], HB, "Amount")
         + " UNION ALL " + _sql_ets("wl_train", ["Country", "Variable"], HB, "Amount")
         + " UNION ALL SELECT Country, Variable, model, Year, mean, variance FROM ("
         + sf.arima_forecast("fit_arima_w", ["Country", "Variable"], HB) + ")", ("wl_train", "fit_arima_w"))


def waste_long(spark, sf_dir):
    return waste(spark, sf_dir).unpivot(["Country", "Year"], WVARS, "Variable", "Amount")


def waste_models(spark, sf_dir):
    # the annual series feed every approach and the test split: materialise once
    wl = cut_lineage(waste_long(spark, sf_dir))
    train, test = fc.split_absolute(wl, IDX, CUT_YEAR)
    # every part of a combination reads the forecasts: write them once
    return cut_lineage(ModelTable(train, ["Country", "Variable"], IDX, "Amount").forecast(HB)), test


def _part(f, var):
    return f.where(F.col("Variable") == var).drop("Variable")


BU_D = {"mean": 9, "variance": 12, "lo80": 9, "hi80": 9, "lo95": 9, "hi95": 9}


def _bounds(sql):
    return f"""SELECT *, mean - 1.28 * sqrt(variance) AS lo80, mean + 1.28 * sqrt(variance) AS hi80,
       mean - 1.96 * sqrt(variance) AS lo95, mean + 1.96 * sqrt(variance) AS hi95 FROM ({sql})"""


@query("fc_bottom_up_diff", with_ctes(_bounds("""
SELECT a.Country, a.model, a.Year, a.mean - b.mean AS mean, a.variance + b.variance AS variance
FROM (SELECT * FROM wfc WHERE Variable = 'Est_Recycled_Amount') a
JOIN (SELECT * FROM wfc WHERE Variable = 'Exports') b ON a.Country = b.Country AND a.model = b.model AND a.Year = b.Year"""),
    "wfc"), doubles=BU_D)
def q_fc_bottom_up_diff(spark, sf_dir):
    """Own processing = recycled − exports from separately forecast parts."""
    f, _ = waste_models(spark, sf_dir)
    return fc.intervals(ev.combine_difference(_part(f, "Est_Recycled_Amount"), _part(f, "Exports"), ["Country", "model", IDX]))


@query("fc_bottom_up_product", with_ctes(_bounds("""
SELECT w.Country, w.model, w.Year, w.mean * r.mean - e.mean AS mean,
       w.mean * w.mean * r.variance + r.mean * r.mean * w.variance + w.variance * r.variance + e.variance AS variance
FROM (SELECT * FROM wfc WHERE Variable = 'Est_Waste_Produced') w
JOIN (SELECT * FROM wfc WHERE Variable = 'Regional_Recycling_Rate') r
  ON w.Country = r.Country AND w.model = r.model AND w.Year = r.Year
JOIN (SELECT * FROM wfc WHERE Variable = 'Exports') e
  ON w.Country = e.Country AND w.model = e.model AND w.Year = e.Year"""), "wfc"), doubles=BU_D)
def q_fc_bottom_up_product(spark, sf_dir):
    """Own processing = waste × rate − exports with the product-variance rule."""
    f, _ = waste_models(spark, sf_dir)
    on = ["Country", "model", IDX]
    return fc.intervals(ev.combine_product_minus(_part(f, "Est_Waste_Produced"), _part(f, "Regional_Recycling_Rate"),
                                                 _part(f, "Exports"), on))


register("bu_dynamic", """
SELECT w.Country, w.Year, w.model, w.mean * r.mean AS Derived_Recycled
FROM (SELECT * FROM wfc WHERE Variable = 'Est_Waste_Produced') w
JOIN (SELECT * FROM wfc WHERE Variable = 'Regional_Recycling_Rate') r
  ON w.Country = r.Country AND w.Year = r.Year AND w.model = r.model""", ("wfc",))
register("bu_controlled", """
SELECT w.Country, w.Year, w.model, w.mean * r.mean AS Derived_Recycled
FROM (SELECT * FROM wfc WHERE Variable = 'Est_Waste_Produced') w
JOIN (SELECT Country, Year, mean FROM wfc WHERE Variable = 'Regional_Recycling_Rate' AND model = 'NAIVE') r
  ON w.Country = r.Country AND w.Year = r.Year""", ("wfc",))


def bu_dynamic(f):
    w = _part(f, "Est_Waste_Produced").select("Country", IDX, "model", F.col("mean").alias("W"))
    r = _part(f, "Regional_Recycling_Rate").select("Country", IDX, "model", F.col("mean").alias("R"))
    return w.join(r, on=["Country", IDX, "model"]).select(
        "Country", IDX, "model", (F.col("W") * F.col("R")).alias("Derived_Recycled"))


def bu_controlled(f):
    w = _part(f, "Est_Waste_Produced").select("Country", IDX, "model", F.col("mean").alias("W"))
    r = _part(f, "Regional_Recycling_Rate").where(F.col("model") == "NAIVE").select("Country", IDX,
                                                                                    F.col("mean").alias("R"))
    return w.join(r, on=["Country", IDX]).select("Country", IDX, "model",
                                                 (F.col("W") * F.col("R")).alias("Derived_Recycled"))


@query("fc_bottom_up_dynamic", with_ctes("SELECT * FROM bu_dynamic", "bu_dynamic"), doubles={"Derived_Recycled": 9})
def q_fc_bottom_up_dynamic(spark, sf_dir):
    """Recycled = waste forecast × rate forecast, each with its own model (joined on year and model)."""
    f, _ = waste_models(spark, sf_dir)
    return bu_dynamic(f)


@query("fc_bottom_up_controlled", with_ctes("SELECT * FROM bu_controlled", "bu_controlled"),
       doubles={"Derived_Recycled": 9})
def q_fc_bottom_up_controlled(spark, sf_dir):
    """Recycled = waste forecast (each model) × the naive rate."""
    f, _ = waste_models(spark, sf_dir)
    return bu_controlled(f)


E3_START, E3_CUT, E3_H = 1993, 1997, 3
E3_D = {**{c: "sig7" for c in ("value", "lo80", "hi80", "lo95", "hi95")}, "RMSE": "sig6", "MAE": "sig6", "MAPE": "sig6"}
register("e3_train", f"""
SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY Country, Variable) AS n FROM wl
  WHERE Amount IS NOT NULL AND Year BETWEEN {E3_START} AND {E3_CUT}) WHERE n >= 2""", ("wl",))
register("e3_arima", sf.arima_fit("e3_train", ["Country", "Variable"], "Amount"), ("e3_train",))


def _e3_sql(model):
    k = ["Country", "Variable"]
    table = {"ETS": _sql_ets("e3_train", k, E3_H, "Amount"), "MEAN": _sql_mean("e3_train", k, E3_H, "Amount"),
             "ARIMA": sf.arima_forecast("e3_arima", k, E3_H)}[model]
    no = lambda *cols: ", ".join(f"NULL::DOUBLE AS {c}" for c in cols)
    bounds, errors = ("lo80", "hi80", "lo95", "hi95"), ("RMSE", "MAE", "MAPE")
    return f"""
SELECT * FROM (WITH f AS (SELECT Country, Variable, Year, mean, sqrt(variance) AS sd FROM ({table}))
SELECT Country, Variable, 'train' AS kind, '{model}' AS model, Year, Amount AS value, {no(*bounds, *errors)} FROM e3_train
UNION ALL SELECT Country, Variable, 'forecast', '{model}', Year, mean, mean - 1.28 * sd, mean + 1.28 * sd, mean - 1.96 * sd, mean + 1.96 * sd, {no(*errors)} FROM f
UNION ALL SELECT Country, Variable, 'bridge', '{model}', max(Year), arg_max(Amount, Year), {no(*bounds, *errors)} FROM e3_train GROUP BY 1, 2
UNION ALL SELECT Country, Variable, 'bridge', '{model}', min(Year), arg_min(mean, Year), {no(*bounds, *errors)} FROM f GROUP BY 1, 2
UNION ALL SELECT f.Country, f.Variable, 'accuracy', '{model}', NULL, NULL, {no(*bounds)}, sqrt(avg((mean - Amount) * (mean - Amount))), avg(abs(mean - Amount)),
  avg(abs((mean - Amount) / nullif(Amount, 0))) * 100 FROM f JOIN wl ON f.Country = wl.Country AND f.Variable = wl.Variable AND f.Year = wl.Year
  WHERE Amount IS NOT NULL GROUP BY 1, 2)"""


def _e3(model):
    def run(spark, sf_dir):
        return interactive_forecast(waste_long(spark, sf_dir), ["Country", "Variable"], IDX, "Amount", E3_START, E3_CUT, model, E3_H)
    run.__doc__ = f"Interactive forecast with {model}: training rows, forecast with bounds, bridge and accuracy of every series, in one plan."
    return run


for _model in ("ETS", "ARIMA", "MEAN"):
    query(f"dom_interactive_{_model.lower()}", with_ctes(_e3_sql(_model), "wl", "e3_train", "e3_arima"), doubles=E3_D)(_e3(_model))


@query("fc_leaderboard", with_ctes("""
SELECT Approach, model, RMSE, MAE, MAPE, CAST(rank() OVER (ORDER BY round(RMSE, 6) ASC NULLS LAST) AS INTEGER) AS rank FROM (
  SELECT Approach, model, sqrt(avg((d - a) * (d - a))) AS RMSE, avg(abs(d - a)) AS MAE,
         avg(abs((d - a) / nullif(a, 0))) * 100 AS MAPE FROM (
    SELECT x.Approach, x.model, x.d, t.Amount AS a FROM (
      SELECT '1. Direct' AS Approach, model, Country, Year, mean AS d FROM wfc WHERE Variable = 'Est_Recycled_Amount'
      UNION ALL SELECT '2. Dynamic bottom-up', model, Country, Year, Derived_Recycled FROM bu_dynamic
      UNION ALL SELECT '3. Controlled bottom-up', model, Country, Year, Derived_Recycled FROM bu_controlled) x
    JOIN (SELECT * FROM wl_test WHERE Variable = 'Est_Recycled_Amount') t ON x.Country = t.Country AND x.Year = t.Year)
  WHERE a IS NOT NULL GROUP BY 1, 2)""", "wfc", "bu_dynamic", "bu_controlled", "wl_test"),
       doubles={"RMSE": 9, "MAE": 9, "MAPE": 6})
def q_fc_leaderboard(spark, sf_dir):
    """Approaches × models on the hold-out, ranked by RMSE."""
    f, test = waste_models(spark, sf_dir)
    direct = _part(f, "Est_Recycled_Amount").select(F.lit("1. Direct").alias("Approach"), "model", "Country", IDX,
                                                    F.col("mean").alias("d"))
    dyn = bu_dynamic(f).select(F.lit("2. Dynamic bottom-up").alias("Approach"), "model", "Country", IDX,
                               F.col("Derived_Recycled").alias("d"))
    ctl = bu_controlled(f).select(F.lit("3. Controlled bottom-up").alias("Approach"), "model", "Country", IDX,
                                  F.col("Derived_Recycled").alias("d"))
    act = test.where(F.col("Variable") == "Est_Recycled_Amount").select("Country", IDX, F.col("Amount").alias("actual"))
    j = direct.unionByName(dyn).unionByName(ctl).join(act, on=["Country", IDX]).withColumnRenamed("d", "mean")
    acc = ev.accuracy(j, ["Approach", "model"])
    # rank on the displayed precision so float noise cannot split ties
    return ev.rank_all(acc.withColumn("_r", F.round("RMSE", 6)), "_r").drop("_r")


@query("fc_trend_growth", with_ctes("""
SELECT OECD_Code AS LOCATION_CODES, regr_slope(Regional_Recycling_Rate, Year) AS Gradient,
       CAST(rank() OVER (ORDER BY regr_slope(Regional_Recycling_Rate, Year) DESC) AS INTEGER) AS rank
FROM regional GROUP BY OECD_Code""", "regional"), doubles={"Gradient": 9})
def q_fc_trend_growth(spark, sf_dir):
    """Linear slope of the recycling rate on time per region, ranked (descending)."""
    from ..plans import prescriptive as pr
    r = pr.regional_rates(b.recycling(spark, sf_dir))
    g = ev.trend_slope(r, ["OECD_Code"], "Year", "Regional_Recycling_Rate").withColumnRenamed(
        "OECD_Code", "LOCATION_CODES")
    return ev.rank_all(g, "Gradient", descending=True)


@query("sink_parquet_partitioned", with_ctes("SELECT * FROM fcm_all WHERE model = 'ETS'", "fcm_all"), doubles=FC_D)
def q_sink_parquet_partitioned(spark, sf_dir):
    """Default sink: forecast table written as Parquet partitioned by model,
    read back with a filter on the partition column (only that folder is
    listed and scanned)."""
    from ..sources import files
    from .common import scratch_path
    path = scratch_path(spark, "forecasts")
    files.write_parquet(models_m(spark, sf_dir), path, partition_by=["model"])
    return files.read_parquet(spark, path).where(F.col("model") == "ETS")
