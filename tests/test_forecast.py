"""Forecast model invariants on literal series."""

import math

import numpy as np
from pyspark.sql import functions as F

from panelwright.operators import arima
from panelwright.operators import forecast as fc
from panelwright.operators.arima import arima_fit, arima_paths, fc_arima
from panelwright.plans import model_table

Y = [10.0, 12.0, 11.0, 13.0, 15.0, 14.0, 16.0, 18.0, 17.0, 19.0]


def _df(spark, series=None):
    rows = [("a", 2000 + i, v) for i, v in enumerate(series or Y)] + [("b", 2000 + i, 5.0 + (i % 3)) for i in range(8)]
    return spark.createDataFrame(rows, "k string, t int, y double")


def test_mean_and_naive_exact(spark):
    df = _df(spark)
    m = {r.t: (r.mean, r.variance) for r in fc.fc_mean(df, ["k"], "t", "y", 3).where("k = 'a'").collect()}
    n = len(Y)
    assert set(m) == {2010, 2011, 2012}
    assert abs(m[2010][0] - np.mean(Y)) < 1e-12
    assert abs(m[2010][1] - np.var(Y, ddof=1) * (1 + 1 / n)) < 1e-9
    nv = {r.t: (r.mean, r.variance) for r in fc.fc_naive(df, ["k"], "t", "y", 3).where("k = 'a'").collect()}
    s2 = float(np.mean(np.diff(Y) ** 2))
    assert nv[2012][0] == Y[-1] and abs(nv[2012][1] - 3 * s2) < 1e-9


def test_rows_and_interval_order(spark):
    out = fc.intervals(fc.fc_naive(_df(spark), ["k"], "t", "y", 5)).collect()
    assert len(out) == 2 * 5
    for r in out:
        assert r.lo95 <= r.lo80 <= r.mean <= r.hi80 <= r.hi95


def _ets_py(y, err, trend, a, b, p):
    """AICc and final forecast of one parameter set; None where undefined."""
    l, tr = y[0], (0.0 if trend == "NN" else y[1] - y[0])
    loss, logs = 0.0, 0.0
    for x in y[1:]:
        f = l + p * tr
        if err == "M" and min(f, x) <= 0:
            return None
        e = x - f
        l, tr = f + a * e, p * tr + b * e
        loss += (e / f) ** 2 if err == "M" else e * e
        logs += 2 * math.log(f) if err == "M" else 0.0
    m = len(y) - 1
    k = fc.ETS_TRENDS[trend]
    if m - k - 1 <= 0 or err == "M" and y[0] <= 0:
        return None
    return m * math.log(max(loss, 1e-12) / m) + logs + 2 * k + 2 * k * (k + 1) / (m - k - 1)


def _ets_series():
    rng = np.random.default_rng(8)
    level, out = 100.0, []
    for _ in range(60):
        x = level * (1 + rng.normal(0, 0.2))
        level += 0.3 * (x - level)
        out.append(max(x, 1.0))
    return {"a": Y, "mult": out, "trend": [5.0 + 2 * t + float(rng.normal()) for t in range(40)],
            "grow": [float(10 * 1.08 ** t * math.exp(rng.normal(0, 0.1))) for t in range(40)], "neg": [float(x) for x in rng.normal(0, 1, 30)]}


def test_ets_search_is_never_worse_than_the_grid(spark):
    series = _ets_series()
    df = spark.createDataFrame([(k, t, float(v)) for k, ys in series.items() for t, v in enumerate(ys)], "k string, t int, y double")
    fits = {r._key.k: r for r in fc.ets_fit(df, ["k"], "t", "y").collect()}
    better = 0
    for k, ys in series.items():
        r = fits[k]
        best = min(v for err in "AM" for g in fc.ets_grid() if (v := _ets_py(ys, err, *g)) is not None)
        own = _ets_py(ys, r.fam[0], r.fam[1:], r.alpha, r.beta, r.phi)
        assert abs(r.aicc - own) < 1e-6 and r.aicc <= best + 1e-9, k
        assert 0.001 <= r.alpha <= 0.999 and r.beta <= r.alpha
        better += r.aicc < best - 1e-3
    assert better >= 3
    assert fits["mult"].fam[0] == "M" and fits["grow"].fam[0] == "M" and fits["neg"].fam[0] == "A"


def test_ets_multiplicative_variance_is_that_of_simulated_futures(spark):
    fit = spark.createDataFrame([(("s",), "MAN", 0.4, 0.1, 1.0, 50.0, 1.5, 0.01, 0.0, 9)],
                                "_key struct<k: string>, fam string, alpha double, beta double, phi double, level double, trend double, sigma2 double, aicc double, _last int")
    got = sorted(fc.ets_forecast(fit, ["k"], "t", 4).collect(), key=lambda r: r.t)
    rng = np.random.default_rng(0)
    l, b = np.full(400_000, 50.0), np.full(400_000, 1.5)
    for r in got:
        f = l + b
        e = rng.normal(0, 0.1, len(f))
        y = f * (1 + e)
        l, b = f * (1 + 0.4 * e), b + 0.1 * f * e
        assert abs(r.mean - y.mean()) < 0.1 and abs(r.variance / y.var() - 1) < 0.02


def _solve(g, idx, target):
    """Normal equations of unit-length columns without row exchanges."""
    if not idx:
        return np.zeros(0)
    if any(g[i][i] == 0 for i in idx):
        return None
    root = np.sqrt([g[i][i] for i in idx])
    m = np.array([[g[a][b] / (root[i] * root[j]) for j, b in enumerate(idx)] + [g[a][target] / root[i]] for i, a in enumerate(idx)]).reshape(len(idx), -1)
    for j in range(len(idx)):
        if m[j, j] <= 1e-7:
            return None
        m[j] = m[j] / m[j, j]
        for i in range(len(idx)):
            if i != j:
                m[i] = m[i] - m[i, j] * m[j]
    return m[:, -1] / root


def _roots_outside(coefficients):
    """Partial coefficients of 1 - a1 z - ... below 0.999."""
    a = list(coefficients)
    while a:
        k = a.pop()
        if abs(k) >= 0.999:
            return False
        a = [(x + k * y) / (1 - k * k) for x, y in zip(a, a[::-1])]
    return True


def _arima_py(y):
    """Plain version of the documented model."""
    def kpss(x):
        n = len(x)
        e = x - x.mean()
        lags = min(int(4 * (n / 100) ** 0.25), n - 1)
        lrv = e @ e / n + sum(2 * (1 - s / (lags + 1)) * (e[s:] @ e[:-s]) / n for s in range(1, lags + 1))
        return np.cumsum(e) @ np.cumsum(e) / (n * n * lrv) if n > 3 and lrv > 1e-12 else 0.0
    y = np.asarray(y, float)
    d = 0 if kpss(y) <= 0.463 else 1 if kpss(np.diff(y)) <= 0.463 else 2
    w = np.diff(y, n=d)
    n = len(w)
    o = min(8, n // 5) if n >= 20 else 2 if n >= 6 else 0
    e = np.zeros(n)
    if n >= 20:
        z = np.array([[1.0, *[w[t - i] for i in range(1, o + 1)], w[t]] for t in range(o, n)])
        beta = _solve(z.T @ z, list(range(o + 1)), o + 1)
        e[o:] = 0 if beta is None else z[:, -1] - z[:, :-1] @ beta
    at = lambda x, t: x[t] if t >= 0 else 0.0
    z = np.array([[1.0, *[at(w, t - i) for i in (1, 2, 3)], *[at(e, t - i) for i in (1, 2, 3)], w[t]] for t in range(o, n)])
    g = z.T @ z
    best = None
    for p in range(4):
        for q in range(4):
            for const in (True, False):
                if p + q > 5 or not (d < 2 or not const if n >= 20 else p <= 2 and q == 0 and (d < 2 or not const) if o == 2 else p == q == 0 and const):
                    continue
                beta = _solve(g, ([0] if const else []) + list(range(1, p + 1)) + list(range(4, 4 + q)), 7)
                m, k, aicc, c, phi, theta, res = n - o, p + q + const + 1, np.inf, 0.0, np.zeros(3), np.zeros(3), None
                if beta is not None:
                    c = beta[0] if const else 0.0
                    phi[:p], theta[:q] = beta[const:const + p], beta[const + p:]
                    eps = np.zeros(n)
                    for t in range(o, n):
                        eps[t] = w[t] - c - sum(phi[i] * at(w, t - 1 - i) + theta[i] * at(eps, t - 1 - i) for i in range(3))
                    res = eps[o:]
                    if m - k - 1 > 0 and _roots_outside(phi) and _roots_outside(-theta):
                        aicc = m * np.log(max(res @ res, 1e-12) / m) + 2 * k + 2 * k * (k + 1) / (m - k - 1)
                rank = (round(aicc, 9) if aicc < np.inf else aicc, p + q, p, not const)
                if best is None or rank < best[0]:
                    best = rank, {"d": d, "p": p, "q": q, "constant": const, "c": c, "phi": phi, "theta": theta, "w": w, "res": res, "aicc": aicc,
                                  "sigma2": res @ res / (m - k + 1) if res is not None and m - k + 1 else None}
    return best[1]


def _arima_future(y, fit, draws):
    w, e, levels = [0.0] * 3 + list(fit["w"]), [0.0] * 3 + list(fit["res"]), [np.asarray(y, float)]
    for _ in range(fit["d"]):
        levels.append(np.diff(levels[-1]))
    for x in draws:
        w.append(fit["c"] + fit["phi"] @ w[:-4:-1] + fit["theta"] @ e[:-4:-1] + x)
        e.append(x)
    f = np.array(w[-len(draws):])
    for k in range(fit["d"], 0, -1):
        f = levels[k - 1][-1] + np.cumsum(f)
    return f


def _ma_series(theta, n, seed, phi=0.0):
    e = np.random.default_rng(seed).normal(size=n + 2)
    out = [0.0]
    for t in range(2, n + 2):
        out.append(phi * out[-1] + e[t] + theta * e[t - 1])
    return 10 + np.array(out[1:])


def _arima_series():
    rng = np.random.default_rng(3)
    ar = [0.0]
    for _ in range(79):
        ar.append(0.7 * ar[-1] + rng.normal())
    return {"s1": np.cumsum(rng.normal(1.0, 1.0, 40)), "s2": 20 + rng.normal(0, 1, 35), "ar": 50 + np.array(ar),
            "s3": np.array([5.0 + 0.3 * t + (t % 4) for t in range(30)]), "quad": np.cumsum(np.cumsum(rng.normal(0.5, 1.0, 60))),
            "ma": _ma_series(0.8, 120, 4), "arma": _ma_series(0.6, 150, 5, 0.5), "ima": np.cumsum(_ma_series(-0.5, 90, 6) - 9),
            "const": np.full(12, 3.0), "flat": np.full(40, 3.0), "n1": [4.0], "n2": [4.0, 5.0], "n5": [1.0, 3.0, 2.0, 4.0, 3.0]}


def test_arima_equals_a_plain_search(spark):
    series = _arima_series()
    df = spark.createDataFrame([(k, t, float(v)) for k, ys in series.items() for t, v in enumerate(ys)], "k string, t int, y double")
    rows = fc_arima(df, ["k"], "t", "y", 4).collect()
    assert len(rows) == 4 * len(series)
    for k, ys in series.items():
        fit = _arima_py(ys)
        got = sorted((r for r in rows if r.k == k), key=lambda r: r.t)
        assert {(r.d, r.p, r.q, r.constant) for r in got} == {(fit["d"], fit["p"], fit["q"], fit["constant"])}, k
        assert np.allclose([r["mean"] for r in got], _arima_future(ys, fit, [0.0] * 4), rtol=1e-6), k
        if fit["sigma2"] is None:
            assert all(r.variance is None for r in got)
        else:
            unit = _arima_future(np.zeros(3), fit | {"c": 0.0, "w": np.zeros(2), "res": np.zeros(2)}, [1.0, 0.0, 0.0, 0.0])
            assert np.allclose([r.variance for r in got], fit["sigma2"] * np.cumsum(np.square(unit)), rtol=1e-5, atol=1e-9), k


def test_arima_finds_moving_average_terms(spark):
    """Series with a known MA term: it is chosen, near its value, and no
    candidate without one has a lower AICc."""
    rows = [(i, t, float(v)) for i in range(8) for t, v in enumerate(_ma_series(0.7, 240, 100 + i))]
    fits = arima_fit(spark.createDataFrame(rows, "k int, t int, y double"), ["k"], "t", "y").collect()
    assert all(r.d == 0 and r.q >= 1 for r in fits)
    first = [r.theta[0] for r in fits if (r.p, r.q) == (0, 1)]
    assert len(first) >= 3 and abs(np.mean(first) - 0.7) < 0.1
    assert all(abs(r.sigma2 - 1) < 0.35 for r in fits)


def test_model_table_fits_each_model_once(spark, monkeypatch):
    df = _df(spark, [float(v) for v in _ma_series(0.5, 40, 9)])
    made = []
    for module, name in ((arima, "arima_fit"), (fc, "ets_fit"), (model_table, "_simple_fit")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name: (made.append(_n), _f(*a))[1])
    table = model_table.ModelTable(df, ["k"], "t", "y")
    short, long = table.forecast(3), table.intervals(6)
    paths = [table.paths(m, 5, 2, seed) for m in ("ARIMA", "NAIVE", "MEAN") for seed in (1, 2)]
    assert sorted(made) == ["_simple_fit", "_simple_fit", "arima_fit", "ets_fit"]
    for out in (short, long, *paths):       # every plan reads stored fits only
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "collect_list" not in plan and "RDDScan" not in plan
    assert short.count() == 2 * 4 * 3 and all(p.count() == 2 * 2 * 5 for p in paths)


def test_model_table_equals_the_plain_models(spark):
    df = _df(spark)
    table = model_table.ModelTable(df, ["k"], "t", "y")
    rows = lambda d: sorted((r.k, r.model, r.t, round(r["mean"], 9), round(r.variance, 9)) for r in d.collect())
    plain = [f(df, ["k"], "t", "y", 3).select("k", "model", "t", "mean", "variance") for f in (fc.fc_mean, fc.fc_naive, fc.fc_ets, fc_arima)]
    assert rows(table.forecast(3)) == sorted(sum((rows(p) for p in plain), []))
    sims = lambda d: sorted((r.k, r.path, r.t, round(r.sim, 9)) for r in d.collect())
    for model in ("MEAN", "NAIVE"):
        assert sims(table.paths(model, 6, 3, 42)) == sims(fc.residual_paths(df, ["k"], "t", "y", 6, 3, 42, model))
    assert sims(table.paths("ARIMA", 6, 3, 42)) == sims(arima_paths(df, ["k"], "t", "y", 6, 3, 42))


def test_arima_paths_draw_the_residuals(spark):
    import hashlib
    series = {k: v for k, v in _arima_series().items() if len(v) > 20}
    df = spark.createDataFrame([(k, t, float(v)) for k, ys in series.items() for t, v in enumerate(ys)], "k string, t int, y double")
    got = {(r.k, r.path, r.t): r.sim for r in arima_paths(df.repartition(3), ["k"], "t", "y", 4, times=2, seed=5).collect()}
    for k, ys in series.items():
        fit = _arima_py(ys)
        for path in (1, 2):
            us = [(int(hashlib.md5(f"{k}|{path}|{len(ys) - 1 + j}|5".encode()).hexdigest()[:8], 16) + 0.5) / 2 ** 32 for j in range(1, 5)]
            future = _arima_future(ys, fit, [fit["res"][int(u * len(fit["res"]))] for u in us])
            assert np.allclose([got[k, path, len(ys) + i] for i in range(4)], future, rtol=1e-6), k


def test_paths_do_not_depend_on_partitioning(spark):
    df = _df(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(tuple(r) for r in fc.residual_paths(df, ["k"], "t", "y", 6, 3, 42).collect())
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = sorted(tuple(r) for r in fc.residual_paths(df.repartition(5), ["k"], "t", "y", 6, 3, 42).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight and len(one) == 2 * 3 * 6


def test_ar1_recovers_slope(spark):
    y = [1.0]
    for _ in range(30):
        y.append(2.0 + 0.5 * y[-1])
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(y)], "k string, t int, y double")
    s = fc.ar1_stats(df, ["k"], "t", "y").collect()[0]
    assert abs(s.phi - 0.5) < 1e-9 and abs(s.c - 2.0) < 1e-9
    f = fc.fc_ar1(df, ["k"], "t", "y", 2).orderBy("t").collect()
    assert abs(f[0].mean - (2.0 + 0.5 * y[-1])) < 1e-9


def test_split_relative_is_panel_wide(spark):
    df = _df(spark)
    train, test = fc.split_relative(df, "t", 4)
    assert train.agg(F.max("t")).collect()[0][0] == 2005
    assert test.where("k = 'b'").count() == 2
