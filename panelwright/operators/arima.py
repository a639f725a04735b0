"""Automatic ARIMA per series, in Spark expressions.

Documented model: d ∈ {0, 1, 2} by repeated KPSS level tests; AR and MA orders
p, q ≤ 3 with p + q ≤ 5, with and without a constant (no constant for d = 2).
Estimation is the innovations regression in two stages (Hannan and Rissanen):
a long autoregression gives residuals, then the differenced series is regressed
on its own lags and on lagged residuals.  All candidates of a series share one
table of cross products over one sample; each solves its part of it
(Gauss–Jordan elimination as an array fold).  Stationary and invertible
candidates (step-down recursion: all partial coefficients below 1) are compared
by the AICc of their own innovations, which are folded through the series with
zero before the sample.  Forecasts, variances (ψ-weights) and bootstrap paths
are folds over the horizon.

A series is collected into one sorted array, bounded by its index range.
Differenced series of under 20 points are not asked for moving-average terms
or a third lag; those of under 6 points get the mean model.  Every series has a
fit, with NULL variance where one point is left.

``arima_fit`` gives the model table; forecasts and paths read it, so a stored
fit serves any number of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import md5_uniform
from ..session import spread_by_keys
from .timeseries import once_each

KPSS_CRIT = 0.463   # fixed value: 5 % critical value of the KPSS level test
EDGE = 0.999        # stationarity and invertibility margin
MIN_POINTS, MA_POINTS = 6, 20
ORDER, ORDER_SUM = 3, 5
LONG_ORDER = 8      # longest first-stage autoregression
PIVOT = 1e-7        # least pivot of scaled cross products


def candidates() -> list[tuple[int, int, bool]]:
    """(p, q, constant) of the search."""
    return [(p, q, c) for p in range(ORDER + 1) for q in range(ORDER + 1) if p + q <= ORDER_SUM for c in (True, False)]


def _kpss(a: str, n: str) -> str:
    """KPSS level statistic of the centred array ``a`` of ``n`` values
    (Bartlett weights, lag truncation 4·(n/100)^¼); 0 for a constant series."""
    lag = f"least(cast(4 * pow({n} / 100D, 0.25D) AS int), {n} - 1)"
    partial = (f"aggregate({a}, named_struct('s', 0D, 'q', 0D), (c, x) -> named_struct('s', c.s + x, "
               f"'q', c.q + (c.s + x) * (c.s + x)), c -> c.q)")
    own = f"aggregate({a}, 0D, (s, x) -> s + x * x)"
    cross = (f"aggregate(if({lag} >= 1, sequence(1, greatest({lag}, 1)), array()), 0D, (t, s) -> t + 2D * (1D - s / ({lag} + 1D)) * "
             f"aggregate(sequence(s, {n} - 1), 0D, (u, i) -> u + {a}[i] * {a}[i - s]))")
    lrv = f"(({own} + {cross}) / {n})"
    return f"CASE WHEN {n} > 3 AND {lrv} > 1e-12 THEN {partial} / ({n} * {n} * {lrv}) ELSE 0D END"


def _diff(a: str) -> str:
    return f"transform(slice({a}, 2, size({a})), (x, i) -> x - {a}[i])"


def _let(name: str, expr: str, body: str) -> str:
    """``body`` with ``expr`` bound to ``name``.  A column that is used once, but
    inside a lambda, would be inlined there and computed anew in every step."""
    return f"transform(array({expr}), {name} -> {body})[0]"


def _cross_products(rows: str, width: str) -> str:
    """Sums of products of every two columns of an array of rows."""
    cols = f"sequence(0, {width} - 1)"
    return _let("z", rows, f"transform({cols}, a -> transform({cols}, b -> aggregate(z, 0D, (s, r) -> s + r[a] * r[b])))")


def _scaled(g: str, idx: str, target: str) -> str:
    """Normal equations of the columns ``idx`` (scaled to unit length) for the
    column ``target``, as rows with the right side last."""
    root = lambda a: f"sqrt(nullif({g}[{a}][{a}], 0D))"
    return (f"transform({idx}, a -> concat(transform({idx}, b -> {g}[a][b] / ({root('a')} * {root('b')})), "
            f"array({g}[a][{target}] / {root('a')})))")


def _eliminated(m: str) -> str:
    """Gauss–Jordan elimination; NULLs where a pivot is too small."""
    pivot = f"nullif(if(m[j][j] > {PIVOT!r}D, m[j][j], 0D), 0D)"
    return (f"aggregate(if(size({m}) > 0, sequence(0, size({m}) - 1), array()), {m}, (m, j) -> transform(m, (r, i) -> "
            f"if(i = j, transform(r, x -> x / {pivot}), zip_with(r, m[j], (x, y) -> x - r[j] / {pivot} * y))))")


def _stable(a: str) -> str:
    """All roots of 1 − a₁z − … lie outside the unit circle (by EDGE)."""
    step = (f"named_struct('ok', s.ok AND abs(s.a[j - 1]) < {EDGE}D, 'a', transform(s.a, (x, i) -> "
            f"if(i < j - 1, (x + s.a[j - 1] * get(s.a, j - 2 - i)) / nullif(1D - s.a[j - 1] * s.a[j - 1], 0D), x)))")
    return f"aggregate(sequence({ORDER}, 1, -1), named_struct('ok', true, 'a', {a}), (s, j) -> {step}, s -> s.ok)"


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}[{i}] * {b}[{i}]" for i in range(ORDER)) + ")"


_LAGS = ", ".join(f"coalesce(get(w, t - {i}), 0D)" for i in range(1, ORDER + 1))
_INNOVATION = f"(w[t] - c - {_dot('phi', f'array({_LAGS})')} - {_dot('theta', 's.e')})"
_PUSHED = "concat(array({x}), slice({a}, 1, " + str(ORDER - 1) + "))"
_ZEROS = "array(" + ", ".join(["0D"] * ORDER) + ")"


def arima_fit(df: DataFrame, keys: Sequence[str], index: str, value: str) -> DataFrame:
    """Model table, one row per series: ``_key`` (struct of the keys), ``y0, y1``
    (values, first differences), ``w`` (differenced values), ``o`` (sample
    start), ``d, p, q, constant, c, phi, theta, sigma2, aicc, resid`` (sample
    innovations) and ``_last`` (last index)."""
    keys = list(keys)
    # the keys travel as one struct, so no name of theirs meets a working column
    rows = df.select(F.struct(*keys).alias("_key"), F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v")).alias("_x"))
    s = spread_by_keys(rows, ["_key"]).groupBy("_key").agg(
        F.array_sort(F.collect_list("_x")).alias("_x"), F.max("_x.i").alias("_last"))
    s = s.select("_key", "_last", F.transform(once_each("_x"), lambda x: x["v"]).alias("y0"))
    s = s.withColumn("y1", F.expr(_diff("y0"))).withColumn("y2", F.expr(_diff("y1")))
    for k in (0, 1):
        n = f"size(y{k})"
        s = s.withColumn("_e", F.expr(f"transform(y{k}, x -> x - aggregate(y{k}, 0D, (s, v) -> s + v) / {n})"))
        s = s.withColumn(f"_t{k}", F.expr(_kpss("_e", n)))
    s = s.withColumn("d", F.expr(f"CASE WHEN _t0 <= {KPSS_CRIT} THEN 0 WHEN _t1 <= {KPSS_CRIT} THEN 1 ELSE 2 END"))
    s = s.withColumn("w", F.expr("CASE d WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE y2 END"))
    s = s.withColumn("o", F.expr(f"CASE WHEN size(w) >= {MA_POINTS} THEN least({LONG_ORDER}, cast(size(w) / 5 AS int)) WHEN size(w) >= {MIN_POINTS} THEN 2 ELSE 0 END"))
    s = s.withColumn("m", F.expr("cast(size(w) - o AS double)"))
    # first stage: a long autoregression where the sample allows
    s = s.withColumn("_z", F.expr(f"if(size(w) >= {MA_POINTS}, transform(sequence(o, size(w) - 1), t -> concat(array(1D), "
                                  "transform(sequence(1, o), i -> w[t - i]), array(w[t]))), array())"))
    s = s.withColumn("_g", F.expr(_cross_products("_z", "(o + 2)")))
    s = s.withColumn("_m", F.expr(f"if(size(_z) > 0, {_scaled('_g', 'sequence(0, o)', 'o + 1')}, array())"))
    s = s.withColumn("_m", F.expr(_eliminated("_m")))
    s = s.withColumn("_long", F.expr("transform(_m, (r, i) -> r[o + 1] / sqrt(_g[i][i]))"))
    s = s.withColumn("_e", F.expr(_let("ar", "_long", "concat(array_repeat(0D, o), transform(_z, r -> r[o + 1] - "
                                       "aggregate(sequence(0, o), 0D, (s, i) -> s + ar[i] * r[i])))")))
    # second stage: one table of cross products of 1, lags, lagged residuals and the value
    lagged = ", ".join(f"coalesce(get(_e, t - {i}), 0D)" for i in range(1, ORDER + 1))
    s = s.withColumn("_z", F.expr(f"transform(sequence(o, size(w) - 1), t -> array(1D, {_LAGS}, {lagged}, w[t]))"))
    s = s.withColumn("_g", F.expr(_cross_products("_z", str(2 * ORDER + 2))))
    options = ", ".join(f"named_struct('p', {p}, 'q', {q}, 'constant', {str(c).lower()})" for p, q, c in candidates())
    allowed = (f"CASE WHEN size(w) >= {MA_POINTS} THEN d < 2 OR NOT g.constant WHEN o = 2 THEN g.p <= 2 AND g.q = 0 AND (d < 2 OR NOT g.constant) "
               "ELSE g.p = 0 AND g.q = 0 AND g.constant END")
    s = s.select("_key", "_last", "y0", "y1", "w", "o", "m", "d", "_g", F.explode(F.expr(f"filter(array({options}), g -> {allowed})")).alias("g"))
    s = s.withColumns({"p": F.col("g.p"), "q": F.col("g.q"), "constant": F.col("g.constant")})
    s = s.withColumn("_idx", F.expr(f"concat(if(constant, array(0), array()), if(p > 0, sequence(1, p), array()), if(q > 0, sequence({ORDER + 1}, {ORDER} + q), array()))"))
    s = s.withColumn("_m", F.expr(_scaled("_g", "_idx", str(2 * ORDER + 1))))
    s = s.withColumn("_m", F.expr(_eliminated("_m")))
    s = s.withColumn("_b", F.expr("transform(_m, (r, i) -> r[size(r) - 1] / sqrt(_g[_idx[i]][_idx[i]]))"))
    free = "if(constant, 1, 0)"
    s = s.withColumn("c", F.expr("if(constant, _b[0], 0D)"))
    s = s.withColumn("phi", F.expr(f"transform(sequence(0, {ORDER - 1}), i -> if(i < p, get(_b, i + {free}), 0D))"))
    s = s.withColumn("theta", F.expr(f"transform(sequence(0, {ORDER - 1}), i -> if(i < q, get(_b, i + p + {free}), 0D))"))
    s = s.withColumn("sse", F.expr(
        f"aggregate(sequence(o, size(w) - 1), named_struct('e', {_ZEROS}, 'sse', 0D), (s, t) -> named_struct('e', "
        f"{_PUSHED.format(x=_INNOVATION, a='s.e')}, 'sse', s.sse + {_INNOVATION} * {_INNOVATION}), s -> s.sse)"))
    s = s.withColumn("k", F.expr(f"p + q + {free} + 1"))
    fits = f"m - k - 1 > 0 AND {_stable('phi')} AND {_stable('transform(theta, x -> -x)')}"
    s = s.withColumn("aicc", F.expr(f"CASE WHEN {fits} THEN m * ln(greatest(sse, 1e-12D) / m) + 2 * k + 2 * k * (k + 1) / (m - k - 1) END"))
    s = s.withColumn("sigma2", F.expr("sse / nullif(m - k + 1, 0D)"))
    # ranked on nine decimals, so float noise does not choose between equal fits
    order = F.struct(F.coalesce(F.round("aicc", 9), F.lit(float("inf"))).alias("a"), (F.col("p") + F.col("q")).alias("n"), "p", (~F.col("constant")).alias("b"))
    cols = ["y0", "y1", "w", "o", "d", "p", "q", "constant", "c", "phi", "theta", "sigma2", "aicc", "_last"]
    best = s.groupBy("_key").agg(F.min_by(F.struct(*cols), order).alias("f")).select("_key", "f.*")
    return best.withColumn("resid", F.expr(
        f"aggregate(sequence(o, size(w) - 1), named_struct('e', {_ZEROS}, 'all', cast(array() AS array<double>)), (s, t) -> named_struct("
        f"'e', {_PUSHED.format(x=_INNOVATION, a='s.e')}, 'all', concat(s.all, array({_INNOVATION}))), s -> s.all)"))


def _newest(a: str) -> str:
    """The last ORDER values, newest first, zeros before the first."""
    return "array(" + ", ".join(f"coalesce(get({a}, size({a}) - {i}), 0D)" for i in range(1, ORDER + 1)) + ")"


def _fold(steps: str) -> str:
    """Fold over ``steps`` (structs step, draw): levels and summed squared ψ-weights."""
    start = (f"named_struct('w', {_newest('w')}, 'e', {_newest('resid')}, 'l1', coalesce(get(y1, size(y1) - 1), 0D), "
             f"'l0', y0[size(y0) - 1], 'psi', {_ZEROS}, 'q1', 0D, 'q0', 0D, 'v', 0D, "
             "'out', cast(array() AS array<struct<step:int,mean:double,v:double>>))")
    new = f"(c + {_dot('phi', 's.w')} + {_dot('theta', 's.e')} + x.draw)"
    l1 = f"CASE WHEN d = 2 THEN s.l1 + {new} ELSE {new} END"
    l0 = f"CASE WHEN d = 0 THEN {new} ELSE s.l0 + {l1} END"
    psi = f"CASE WHEN x.step = 1 THEN 1D ELSE coalesce(get(theta, x.step - 2), 0D) + {_dot('phi', 's.psi')} END"
    q1 = f"CASE WHEN d = 2 THEN s.q1 + {psi} ELSE {psi} END"
    q0 = f"CASE WHEN d = 0 THEN {psi} ELSE s.q0 + {q1} END"
    v = f"s.v + ({q0}) * ({q0})"
    return (f"aggregate({steps}, {start}, (s, x) -> named_struct('w', {_PUSHED.format(x=new, a='s.w')}, 'e', {_PUSHED.format(x='x.draw', a='s.e')}, "
            f"'l1', {l1}, 'l0', {l0}, 'psi', {_PUSHED.format(x=psi, a='s.psi')}, 'q1', {q1}, 'q0', {q0}, 'v', {v}, "
            f"'out', concat(s.out, array(named_struct('step', x.step, 'mean', {l0}, 'v', {v})))), s -> s.out)")


def arima_forecast(fit: DataFrame, keys: Sequence[str], index: str, h: int) -> DataFrame:
    """Forecast table of a model table: ``model, index, mean, variance, p, d, q, constant, aicc``."""
    steps = f"transform(sequence(1, {int(h)}), j -> named_struct('step', j, 'draw', 0D))"
    out = fit.withColumn("x", F.explode(F.expr(_fold(steps))))
    return out.select(*[F.col("_key")[k].alias(k) for k in keys], F.lit("ARIMA").alias("model"), (F.col("_last") + F.col("x.step")).alias(index),
                      F.col("x.mean").alias("mean"), (F.col("sigma2") * F.col("x.v")).alias("variance"),
                      "p", "d", "q", "constant", "aicc")


def arima_futures(fit: DataFrame, keys: Sequence[str], index: str, h: int, times: int = 1, seed: int = 123) -> DataFrame:
    """Bootstrap futures of a model table: the fitted recursion driven by
    in-sample innovations drawn at position floor(u·m), u = md5(key, path,
    step, seed), so a path depends neither on partitioning nor on retries."""
    fit = fit.withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(times))))
    u = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda j: F.struct(
        j.alias("step"), md5_uniform(*[F.col("_key")[k] for k in keys], F.col("path"), F.col("_last") + j, seed=seed).alias("u")))
    fit = fit.withColumn("u", u).withColumn("draws", F.expr(
        "transform(u, x -> named_struct('step', x.step, 'draw', resid[cast(floor(x.u * size(resid)) AS int)]))"))
    out = fit.withColumn("x", F.explode(F.expr(_fold("draws"))))
    return out.select(*[F.col("_key")[k].alias(k) for k in keys], "path", (F.col("_last") + F.col("x.step")).alias(index), F.col("x.mean").alias("sim"))


def fc_arima(df: DataFrame, keys: Sequence[str], index: str, value: str, h: int) -> DataFrame:
    """Forecast table with the chosen orders (see ``arima_forecast``)."""
    return arima_forecast(arima_fit(df, keys, index, value), keys, index, h)


def arima_paths(df: DataFrame, keys: Sequence[str], index: str, value: str, h: int, times: int = 1,
                seed: int = 123) -> DataFrame:
    """Bootstrap futures of a series table (see ``arima_futures``)."""
    return arima_futures(arima_fit(df, keys, index, value), keys, index, h, times, seed)
