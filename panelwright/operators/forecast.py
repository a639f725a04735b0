"""Per-series forecasting models as Spark jobs.

Input: a long table ``(keys…, index INT, value DOUBLE)`` with one row per key
and index and no NULL values (run ``fill_chain`` first).  Output: a forecast
table ``(keys…, model, index, mean, variance)``; intervals, paths and
accuracy are derived from it.

* MEAN, NAIVE and AR(1) are plain aggregates / windows (JVM side, SQL-checkable).
* ETS is a grid and pattern search folded over the sorted series with the
  built-in ``aggregate`` higher-order function; the winner is a ``min_by`` on
  AICc — no Python.
* Automatic ARIMA is in ``operators.arima``.

A series is bounded by its index range (years / months): collecting one into
an array is bounded by that length, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import md5_uniform
from ..session import spread_by_keys
from .timeseries import once_each

Keys = Sequence[str]

# Interval multipliers used by the reference (80 % and 95 %).
Z80, Z95 = 1.28, 1.96


def _horizon(h: int, last: Column) -> Column:
    return F.explode(F.sequence(last + 1, last + h))


def split_relative(df: DataFrame, index: str, holdout: int = 4) -> tuple[DataFrame, DataFrame]:
    """Train = index ≤ (panel-wide max − holdout); test = the rest."""
    cut = df.agg(F.max(index)).scalar() - F.lit(holdout)
    return df.where(F.col(index) <= cut), df.where(F.col(index) > cut)


def split_absolute(df: DataFrame, index: str, last_train) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(index) <= last_train), df.where(F.col(index) > last_train)


def split_range(df: DataFrame, keys: Keys, index: str, start, cutoff, min_rows: int = 2) -> DataFrame:
    """Train rows in [start, cutoff] of series that keep at least ``min_rows`` rows."""
    t = df.where(F.col(index).between(start, cutoff))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return t.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n")


# --- MEAN / NAIVE ----------------------------------------------------------------

def fc_mean(df: DataFrame, keys: Keys, index: str, value: str, h: int) -> DataFrame:
    """Mean model: mean of the series, variance σ²(1 + 1/n), σ² = sample variance."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_s2"),
                              F.count(value).alias("_n"), F.max(index).alias("_last"))
    return s.select(*keys, F.lit("MEAN").alias("model"), _horizon(h, F.col("_last")).alias(index),
                    F.col("_m").alias("mean"),
                    (F.col("_s2") * (F.lit(1.0) + F.lit(1.0) / F.col("_n"))).alias("variance"))


def naive_stats(df: DataFrame, keys: Keys, index: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(index)
    d = df.withColumn("_e", F.col(value) - F.lag(value).over(w))
    return d.groupBy(*keys).agg(F.max_by(value, index).alias("_y"), F.avg(F.col("_e") * F.col("_e")).alias("_s2"),
                                F.max(index).alias("_last"))


def fc_naive(df: DataFrame, keys: Keys, index: str, value: str, h: int) -> DataFrame:
    """Random walk: last value, variance h·σ² with σ² = mean squared one-step change."""
    s = naive_stats(df, keys, index, value)
    hz = _horizon(h, F.col("_last")).alias(index)
    out = s.select(*keys, "_y", "_s2", "_last", hz)
    return out.select(*keys, F.lit("NAIVE").alias("model"), index, F.col("_y").alias("mean"),
                      (F.col("_s2") * (F.col(index) - F.col("_last"))).alias("variance"))


# --- AR(1) by conditional least squares ---------------------------------------------

def ar1_stats(df: DataFrame, keys: Keys, index: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(index)
    d = df.withColumn("_lag", F.lag(value).over(w))
    s = d.groupBy(*keys).agg(F.regr_slope(value, "_lag").alias("phi"), F.regr_intercept(value, "_lag").alias("c"),
                             F.regr_count(value, "_lag").alias("_m"), F.regr_syy(value, "_lag").alias("_syy"),
                             F.regr_sxy(value, "_lag").alias("_sxy"), F.max_by(value, index).alias("_y"),
                             F.max(index).alias("_last"))
    # least squares: SSE = Syy − slope · Sxy
    return s.withColumn("sigma2", F.when(F.col("_m") > 2, F.greatest(F.col("_syy") - F.col("phi") * F.col("_sxy"), F.lit(0.0))
                                         / (F.col("_m") - 2)))


def fc_ar1(df: DataFrame, keys: Keys, index: str, value: str, h: int) -> DataFrame:
    """AR(1) with constant: mean_h = c·Σφ^i + φ^h·y_n; variance σ²·Σ_{j<h} φ^{2j}."""
    s = ar1_stats(df, keys, index, value)
    s = s.select(*keys, "phi", "c", "sigma2", "_y", "_last", _horizon(h, F.col("_last")).alias(index))
    k = (F.col(index) - F.col("_last")).cast("double")
    phi = F.col("phi")
    geo = F.when(F.abs(phi - 1.0) < 1e-12, k).otherwise((F.lit(1.0) - F.pow(phi, k)) / (F.lit(1.0) - phi))
    geo2 = F.when(F.abs(phi * phi - 1.0) < 1e-12, k).otherwise(
        (F.lit(1.0) - F.pow(phi, 2.0 * k)) / (F.lit(1.0) - phi * phi))
    return s.select(*keys, F.lit("AR1").alias("model"), index,
                    (F.col("c") * geo + F.pow(phi, k) * F.col("_y")).alias("mean"),
                    (F.col("sigma2") * geo2).alias("variance"))


# --- ETS: grid and pattern search folded with aggregate() ------------------------------

# fixed values: parameters by trend type (initial states and variance included)
ETS_TRENDS = {"NN": 2, "AN": 4, "AdN": 5}
ETS_HALVINGS = 6
ETS_BOUNDS = {"alpha": (0.001, 0.999), "beta": (0.0001, 0.999), "phi": (0.8, 0.98)}


def ets_grid(alphas=None, betas=None, phis=None) -> list[tuple[str, float, float, float]]:
    """(trend, α, β, φ) start points: none (NN), additive (AN), damped (AdN); β ≤ α."""
    alphas = alphas or [round(0.05 + 0.1 * i, 2) for i in range(10)]
    betas = betas or [0.01, 0.05, 0.1, 0.2, 0.3]
    phis = phis or [0.8, 0.9, 0.98]
    grid = [("NN", a, 0.0, 1.0) for a in alphas]
    grid += [("AN", a, b, 1.0) for a in alphas for b in betas if b <= a]
    grid += [("AdN", a, b, p) for a in alphas for b in betas if b <= a for p in phis]
    return grid


def collect_series(df: DataFrame, keys: Keys, index: str, value: str) -> DataFrame:
    """One row per series: ``_key`` (struct of the keys, so no name of theirs
    meets a working column), ``y`` (values sorted by index), ``n``, ``_last``."""
    rows = df.select(F.struct(*keys).alias("_key"), F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v")).alias("_x"))
    s = spread_by_keys(rows, ["_key"]).groupBy("_key").agg(F.array_sort(F.collect_list("_x")).alias("_s"), F.max("_x.i").alias("_last"))
    s = s.withColumn("_s", once_each("_s"))
    return s.select("_key", F.col("_s.v").alias("y"), F.size("_s").alias("n"), "_last")


# One pass of a parameter struct q through the series: f is the next one-step
# forecast, g its (damped) trend part; sums of squared errors, absolute and
# relative, and of log forecasts; ok while forecasts and values are positive.
_ETS_PASS = """
aggregate(slice(y, 2, n),
  named_struct('f', y[0] + IF(trend = 'NN', 0D, q.phi * (get(y, 1) - y[0])), 'g', IF(trend = 'NN', 0D, q.phi * (get(y, 1) - y[0])),
               'sse', 0D, 'rse', 0D, 'lf', 0D, 'ok', y[0] > 0D),
  (s, x) -> named_struct(
    'f', s.f + q.alpha * (x - s.f) + q.phi * (s.g + q.beta * (x - s.f)),
    'g', q.phi * (s.g + q.beta * (x - s.f)),
    'sse', s.sse + (x - s.f) * (x - s.f),
    'rse', s.rse + IF(err = 'M' AND s.ok AND s.f > 0D, (x - s.f) / s.f * ((x - s.f) / s.f), 0D),
    'lf', s.lf + IF(err = 'M' AND s.ok AND s.f > 0D, ln(s.f), 0D),
    'ok', s.ok AND s.f > 0D AND x > 0D),
  s -> named_struct('a', coalesce(round({aicc}, 9), {none}D), 'z', IF(m - k - 1 > 0, 0D, s.sse), 'alpha', q.alpha, 'beta', q.beta, 'phi', q.phi,
                    'f', s.f, 'g', s.g, 'ss', IF(err = 'M', s.rse, s.sse)))"""
_ETS_AICC = ("IF(err = 'M', IF(s.ok, m * ln(greatest(s.rse, 1e-12D) / nullif(m, 0D)) + 2D * s.lf, NULL), m * ln(greatest(s.sse, 1e-12D) / nullif(m, 0D))) "
             "+ 2 * k + IF(m - k - 1 > 0, 2 * k * (k + 1) / (m - k - 1), NULL)")
_NO_AICC = "1e300"


def _ets_moves() -> str:
    """The parameters one step up or down each, within their bounds (β ≤ α)."""
    (a0, a1), (b0, _), (p0, p1) = ETS_BOUNDS.values()
    moves = ", ".join(f"named_struct('a', {da}D, 'b', {db}D, 'p', {dp}D)" for da, db, dp in
                      ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
    alpha = f"least(greatest(b.alpha + v.a * 0.1D * pow(0.5D, j), {a0}D), {a1}D)"
    return (f"transform(filter(array({moves}), v -> trend = 'AdN' OR (v.p = 0D AND (trend = 'AN' OR v.b = 0D))), v -> named_struct('alpha', {alpha}, "
            f"'beta', IF(trend = 'NN', 0D, least(greatest(b.beta + v.b * 0.1D * pow(0.5D, j), {b0}D), {alpha})), "
            f"'phi', IF(trend = 'AdN', least(greatest(b.phi + v.p * 0.1D * pow(0.5D, j), {p0}D), {p1}D), 1D)))")


def ets_fit(df: DataFrame, keys: Keys, index: str, value: str, grid=None) -> DataFrame:
    """Model table, one row per series: ``_key`` and the best ``fam, alpha, beta,
    phi`` by ``aicc`` with the final ``level``, ``trend`` and ``sigma2`` (relative
    for multiplicative errors).

    Families: additive or multiplicative errors (A, M) × no, additive or damped
    trend; M only for series and fits that stay positive.  Parameters are
    continuous: from the best point of a grid, a pattern search tries a step up
    and down in each, with steps halved ``ETS_HALVINGS`` times, so the result is
    never worse than the grid's.  −2 log L is m·ln(SSE/m) for A and
    m·ln(Σ(e/f)²/m) + 2Σ ln f for M, AICc adds 2k + 2k(k+1)/(m−k−1); m = n−1
    one-step errors, k = 2, 4, 5.  Initial state: l₀ = y₁, b₀ = y₂ − y₁.  A
    series too short for any AICc (under 5 points) gets the additive level
    model of the least SSE; with one point its variance is NULL.
    """
    grid = grid or ets_grid()
    points = {t: "array(" + ", ".join(f"named_struct('alpha', {a!r}D, 'beta', {b!r}D, 'phi', {p!r}D)" for f, a, b, p in grid if f == t) + ")"
              for t in ETS_TRENDS}
    points = {t: x for t, x in points.items() if x != "array()"}
    # one exchange: the input is hash-partitioned by the series keys into a
    # core-sized partition count, and the collect reuses that partitioning
    s = collect_series(df, keys, index, value)
    families = ", ".join(f"named_struct('err', '{e}', 'trend', '{t}', 'k', {ETS_TRENDS[t]})" for e in "AM" for t in points)
    c = s.withColumn("g", F.explode(F.expr(f"filter(array({families}), g -> g.err = 'A' OR array_min(y) > 0)")))
    c = c.select("_key", "y", "n", "_last", "g.err", "g.trend", "g.k", (F.col("n") - 1).cast("double").alias("m"))
    score = _ETS_PASS.replace("{aicc}", _ETS_AICC).replace("{none}", _NO_AICC)
    start = "CASE trend " + " ".join(f"WHEN '{t}' THEN {x}" for t, x in points.items()) + " END"
    c = c.withColumn("best", F.expr(f"array_min(transform({start}, q -> {score}))"))
    c = c.withColumn("best", F.expr(f"aggregate(sequence(1, {ETS_HALVINGS}), best, (b, j) -> array_min(concat(array(b), transform({_ets_moves()}, q -> {score}))))"))
    rank = F.struct("best.a", "k", "err", "best.z", "best.alpha", "best.beta", "best.phi")
    best = c.groupBy("_key").agg(F.min_by(F.struct("err", "trend", "best", "k", "m", "_last"), rank).alias("b"))
    sigma2 = F.col("b.best.ss") / F.when(F.col("b.m") - F.col("b.k") > 0, F.col("b.m") - F.col("b.k")).otherwise(F.nullif("b.m", F.lit(0.0)))
    return best.select("_key", F.concat("b.err", "b.trend").alias("fam"), "b.best.alpha", "b.best.beta", "b.best.phi",
                       (F.col("b.best.f") - F.col("b.best.g")).alias("level"), (F.col("b.best.g") / F.col("b.best.phi")).alias("trend"),
                       sigma2.alias("sigma2"), F.when(F.col("b.best.a") < float(_NO_AICC), F.col("b.best.a")).alias("aicc"), F.col("b._last").alias("_last"))


def ets_forecast(fit: DataFrame, keys: Keys, index: str, h: int) -> DataFrame:
    """Forecast table of an ETS model table.  Mean l + (φ+…+φ^h)·b.  Variance
    with c_j = α + β(φ+…+φ^j): additive errors σ²(1 + Σ_{j<h} c_j²);
    multiplicative (1 + σ²)θ_h − μ_h², θ_h = μ_h² + σ² Σ_{j<h} c_j² θ_{h−j}."""
    total = "IF(phi = 1D, {j} * 1D, phi * (1 - pow(phi, {j})) / (1 - phi))"
    mean = f"(level + {total.format(j='j')} * trend)"
    weight = f"pow(alpha + beta * {total.format(j='i')}, 2)"
    add = f"(1D + aggregate(sequence(1, j), 0D, (t, i) -> t + IF(i < j, {weight}, 0D)))"
    theta = (f"aggregate(sequence(1, {int(h)}), cast(array() AS array<double>), (t, j) -> concat(t, array({mean} * {mean} + sigma2 * "
             f"aggregate(sequence(1, j), 0D, (u, i) -> u + IF(i < j, {weight} * get(t, j - 1 - i), 0D)))))")
    f = fit.withColumn("_t", F.expr(f"IF(fam LIKE 'M%', {theta}, NULL)"))
    variance = f"IF(fam LIKE 'M%', greatest((1D + sigma2) * _t[j - 1] - {mean} * {mean}, 0D), sigma2 * {add})"
    f = f.withColumn("x", F.explode(F.expr(f"transform(sequence(1, {int(h)}), j -> named_struct('j', j, 'mean', {mean}, 'variance', {variance}))")))
    return f.select(*[F.col("_key")[k].alias(k) for k in keys], F.lit("ETS").alias("model"), (F.col("_last") + F.col("x.j")).alias(index),
                    F.col("x.mean").alias("mean"), F.col("x.variance").alias("variance"))


def fc_ets(df: DataFrame, keys: Keys, index: str, value: str, h: int, grid=None) -> DataFrame:
    """ETS forecast of a series table (see ``ets_fit`` and ``ets_forecast``)."""
    return ets_forecast(ets_fit(df, keys, index, value, grid), keys, index, h)


# --- derived tables ------------------------------------------------------------------

def intervals(fc: DataFrame) -> DataFrame:
    """80 % / 95 % bounds from mean and variance with the reference's multipliers."""
    sd = F.sqrt("variance")
    return fc.withColumns({"lo80": F.col("mean") - Z80 * sd, "hi80": F.col("mean") + Z80 * sd,
                           "lo95": F.col("mean") - Z95 * sd, "hi95": F.col("mean") + Z95 * sd})


def residual_paths(df: DataFrame, keys: Keys, index: str, value: str, h: int, times: int, seed: int,
                   model: str = "NAIVE") -> DataFrame:
    """Scenario table for MEAN / NAIVE: each step draws one in-sample residual
    at position ``1 + floor(u·m)`` with u = md5(key, path, step, seed).

    NAIVE paths are the last value plus a running sum of the draws (window
    over steps); MEAN paths are the mean plus the draw.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(index)
    if model == "NAIVE":
        r = df.withColumn("_e", F.col(value) - F.lag(value).over(w)).where(F.col("_e").isNotNull())
        base = F.max_by(value, index)
    else:
        r = df.withColumn("_e", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
        base = F.avg(value)
    r = r.withColumn("_pos", F.row_number().over(w))
    s = df.groupBy(*keys).agg(base.alias("_base"), F.max(index).alias("_last"))
    m = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    grid = (s.join(m, on=keys)
             .withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(times))))
             .withColumn(index, F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + h))))
    u = md5_uniform(*[F.col(k) for k in keys], F.col("path"), F.col(index), seed=seed)
    grid = grid.withColumn("_pos", (F.floor(u * F.col("_m")) + 1).cast("int"))
    g = grid.join(r.select(*keys, "_pos", "_e"), on=[*keys, "_pos"], how="left")
    if model == "NAIVE":
        cw = Window.partitionBy(*keys, "path").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
        sim = F.col("_base") + F.sum("_e").over(cw)
    else:
        sim = F.col("_base") + F.col("_e")
    return g.select(*keys, "path", index, sim.alias("sim"))
