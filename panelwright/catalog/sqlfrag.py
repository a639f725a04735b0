"""SQL text builders for the oracle side of window operators (DuckDB dialect)."""

from __future__ import annotations


def _keys(keys) -> str:
    return ", ".join(keys)


def w_back(keys, index) -> str:
    return f"(PARTITION BY {_keys(keys)} ORDER BY {index} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def w_fwd(keys, index) -> str:
    return f"(PARTITION BY {_keys(keys)} ORDER BY {index} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def prev_val(value, keys, index) -> str:
    return f"last_value({value} IGNORE NULLS) OVER {w_back(keys, index)}"


def next_val(value, keys, index) -> str:
    return f"first_value({value} IGNORE NULLS) OVER {w_fwd(keys, index)}"


def interp(value, keys, index, x=None) -> str:
    x = x or index
    px = f"last_value(CASE WHEN {value} IS NOT NULL THEN {x} END IGNORE NULLS) OVER {w_back(keys, index)}"
    nx = f"first_value(CASE WHEN {value} IS NOT NULL THEN {x} END IGNORE NULLS) OVER {w_fwd(keys, index)}"
    pv, nv = prev_val(value, keys, index), next_val(value, keys, index)
    return (f"CASE WHEN {value} IS NOT NULL THEN {value} "
            f"WHEN ({px}) IS NOT NULL AND ({nx}) IS NOT NULL AND ({nx}) > ({px}) "
            f"THEN ({pv}) + (({nv}) - ({pv})) * CAST({x} - ({px}) AS DOUBLE) / CAST(({nx}) - ({px}) AS DOUBLE) END")


def chain(value, keys, index, x=None, final=None) -> str:
    parts = [interp(value, keys, index, x), prev_val(value, keys, index), next_val(value, keys, index)]
    if final is not None:
        parts.append(repr(float(final)))
    return "coalesce(" + ", ".join(parts) + ")"


def if_else3(cond, yes, no) -> str:
    return f"CASE WHEN ({cond}) IS NULL THEN NULL WHEN ({cond}) THEN {yes} ELSE {no} END"


def md5_uniform(parts: str, seed, tag: str = "") -> str:
    """DuckDB text of ``functions.exprs.md5_uniform`` (same bytes hashed)."""
    extra = f"'{tag}', " if tag else ""
    return (f"((('0x' || substr(md5(concat_ws('|', {parts}, {extra}'{seed}')), 1, 8))::BIGINT + 0.5) "
            "/ 4294967296.0)")


def std_normal(parts: str, seed) -> str:
    u1, u2 = md5_uniform(parts, seed, "u1"), md5_uniform(parts, seed, "u2")
    return f"(sqrt(-2.0 * ln({u1})) * cos(6.283185307179586 * {u2}))"


def residual_paths(src: str, keys, value: str, index: str, h: int, times: int, seed, model: str) -> str:
    """DuckDB text of ``operators.forecast.residual_paths``."""
    k = ", ".join(keys)
    resid = (f"{value} - lag({value}) OVER (PARTITION BY {k} ORDER BY {index})" if model == "NAIVE"
             else f"{value} - avg({value}) OVER (PARTITION BY {k})")
    base = f"arg_max({value}, {index})" if model == "NAIVE" else f"avg({value})"
    r0 = f"(SELECT * FROM (SELECT *, {resid} AS _e FROM {src}) WHERE _e IS NOT NULL)"
    parts = ", ".join([*keys, "CAST(path AS VARCHAR)", f"CAST({index} AS VARCHAR)"])
    u = md5_uniform(parts, seed)
    sim = (f"_base + sum(_e) OVER (PARTITION BY {k}, path ORDER BY {index} "
           "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") if model == "NAIVE" else "_base + _e"
    on = " AND ".join(f"g.{c} = r.{c}" for c in keys)
    gsel = ", ".join(f"g.{c}" for c in keys)
    return f"""
SELECT {k}, path, {index}, {sim} AS sim FROM (
  SELECT {gsel}, g.path, g.{index}, g._base, r._e FROM (
    SELECT *, CAST(floor({u} * _m) + 1 AS INTEGER) AS _pos FROM (
      SELECT *, CAST(unnest(generate_series(_last + 1, _last + {h})) AS INTEGER) AS {index} FROM (
        SELECT s.*, m._m, CAST(unnest(generate_series(1, {times})) AS INTEGER) AS path
        FROM (SELECT {k}, {base} AS _base, max({index}) AS _last FROM {src} GROUP BY {k}) s
        JOIN (SELECT {k}, count(*) AS _m FROM {r0} GROUP BY {k}) m USING ({k})))) g
  LEFT JOIN (SELECT {k}, _e, row_number() OVER (PARTITION BY {k} ORDER BY {index}) AS _pos FROM {r0}) r
    ON {on} AND g._pos = r._pos)"""


def _kpss(e: str, n: str) -> str:
    lag = f"least(CAST(trunc(4 * pow({n} / 100.0, 0.25)) AS BIGINT), {n} - 1)"
    run = (f"list_reduce({e}, lambda c, x: {{'s': c.s + x, 'q': c.q + (c.s + x) * (c.s + x)}}, {{'s': 0.0::DOUBLE, 'q': 0.0::DOUBLE}}).q")
    lrv = (f"((list_sum(list_transform({e}, lambda x: x * x)) + coalesce(list_sum(list_transform(range(1, {lag} + 1), lambda s: 2.0 * (1.0 - s / ({lag} + 1.0)) "
           f"* list_sum(list_transform(range(s + 1, {n} + 1), lambda i: {e}[i] * {e}[i - s])))), 0.0)) / {n})")
    return f"CASE WHEN {n} > 3 AND {lrv} > 1e-12 THEN {run} / ({n} * {n} * {lrv}) ELSE 0.0 END"


_Z = "0.0::DOUBLE"


def _eliminated(m: str) -> str:
    pivot = "nullif(CASE WHEN m[j][j] > 1e-7 THEN m[j][j] ELSE 0.0 END, 0.0)"
    return (f"list_reduce(range(1, len({m}) + 1), lambda m, j: list_transform(m, lambda r, i: CASE WHEN i = j THEN list_transform(r, lambda x: x / {pivot}) "
            f"ELSE list_transform(r, lambda x, n: x - r[j] / {pivot} * m[j][n]) END), {m})")


def _scaled(g: str, idx: str, target: str) -> str:
    root = lambda a: f"sqrt(nullif({g}[{a}][{a}], 0.0))"
    return (f"list_transform({idx}, lambda a: list_append(list_transform({idx}, lambda b: {g}[a][b] / ({root('a')} * {root('b')})), "
            f"{g}[a][{target}] / {root('a')}))")


def _cross_products(rows: str, width: str) -> str:
    return (f"list_transform(range(1, {width} + 1), lambda a: list_transform(range(1, {width} + 1), "
            f"lambda b: list_sum(list_transform({rows}, lambda r: r[a] * r[b]))))")


def _stable(a1: str, a2: str, a3: str) -> str:
    """Partial coefficients of a third-order polynomial below the margin, written out."""
    b1, b2 = f"(({a1} + {a3} * {a2}) / nullif(1 - {a3} * {a3}, 0))", f"(({a2} + {a3} * {a1}) / nullif(1 - {a3} * {a3}, 0))"
    return f"(abs({a3}) < 0.999 AND abs({b2}) < 0.999 AND abs(({b1} + {b2} * {b1}) / nullif(1 - {b2} * {b2}, 0)) < 0.999)"


_ARIMA_LAGS = ", ".join(f"CASE WHEN t > {i} THEN w[t - {i}] ELSE 0.0 END" for i in (1, 2, 3))
_ARIMA_INNOVATION = ("(w[t] - c - (phi[1] * l[1] + phi[2] * l[2] + phi[3] * l[3]) - (theta[1] * s.e[1] + theta[2] * s.e[2] + theta[3] * s.e[3]))"
                     .replace("l[1]", "CASE WHEN t > 1 THEN w[t - 1] ELSE 0.0 END").replace("l[2]", "CASE WHEN t > 2 THEN w[t - 2] ELSE 0.0 END")
                     .replace("l[3]", "CASE WHEN t > 3 THEN w[t - 3] ELSE 0.0 END"))


def arima_fit(src: str, keys, value: str, index: str = "Year") -> str:
    """DuckDB text of ``operators.arima.arima_fit``."""
    k = ", ".join(keys)
    diff = "list_transform(range(2, len({a}) + 1), lambda i: {a}[i] - {a}[i - 1])"
    options = ", ".join(f"({p}, {q}, {c})" for p in range(4) for q in range(4) if p + q <= 5 for c in ("true", "false"))
    lagged = ", ".join(f"CASE WHEN t > {i} THEN coalesce(e[t - {i}], 0.0) ELSE 0.0 END" for i in (1, 2, 3))
    sse = (f"list_reduce(range(o + 1, len(w) + 1), lambda s, t: {{'e': [{_ARIMA_INNOVATION}, s.e[1], s.e[2]], "
           f"'sse': s.sse + {_ARIMA_INNOVATION} * {_ARIMA_INNOVATION}}}, {{'e': [{_Z}, {_Z}, {_Z}], 'sse': {_Z}}}).sse")
    resid = (f"list_reduce(range(o + 1, len(w) + 1), lambda s, t: {{'e': [{_ARIMA_INNOVATION}, s.e[1], s.e[2]], "
             f"'out': list_append(s.out, {_ARIMA_INNOVATION})}}, {{'e': [{_Z}, {_Z}, {_Z}], 'out': []::DOUBLE[]}}).out")
    stable = _stable("phi[1]", "phi[2]", "phi[3]") + " AND " + _stable("-theta[1]", "-theta[2]", "-theta[3]")
    return f"""
SELECT *, {resid} AS resid FROM (
  SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY round(aicc, 9) NULLS LAST, p + q, p, NOT constant) AS rn FROM (
    SELECT *, sse / nullif(m - k + 1, 0) AS sigma2,
      CASE WHEN m - k - 1 > 0 AND {stable} THEN m * ln(greatest(sse, 1e-12) / m) + 2 * k + 2 * k * (k + 1) / (m - k - 1) END AS aicc FROM (
      SELECT *, {sse} AS sse, p + q + constant::INT + 1 AS k FROM (
        SELECT *, CASE WHEN constant THEN b[1] ELSE 0.0 END AS c,
               list_transform(range(1, 4), lambda i: CASE WHEN i <= p THEN b[i + constant::INT] ELSE 0.0 END) AS phi,
               list_transform(range(1, 4), lambda i: CASE WHEN i <= q THEN b[i + p + constant::INT] ELSE 0.0 END) AS theta FROM (
          SELECT *, list_transform(mm, lambda r, i: r[len(r)] / sqrt(g2[idx[i]][idx[i]])) AS b FROM (
            SELECT *, {_eliminated('m0')} AS mm FROM (
              SELECT *, {_scaled('g2', 'idx', '8')} AS m0 FROM (
                SELECT f.*, x.*, list_concat(CASE WHEN constant THEN [1] ELSE [] END, range(2, p + 2), range(5, q + 5))::BIGINT[] AS idx FROM (
                  SELECT *, {_cross_products('z2', '8')} AS g2 FROM (
                    SELECT *, list_transform(range(o + 1, len(w) + 1), lambda t: [1.0::DOUBLE, {_ARIMA_LAGS}, {lagged}, w[t]]) AS z2 FROM (
                      SELECT *, list_concat(list_transform(range(1, o + 1), lambda i: 0.0::DOUBLE), list_transform(z, lambda r: r[o + 2] - list_sum(list_transform(range(1, o + 2), lambda i: ar[i] * r[i])))) AS e FROM (
                        SELECT *, list_transform(m1, lambda r, i: r[o + 2] / sqrt(g1[i][i])) AS ar FROM (
                          SELECT *, {_eliminated('m00')} AS m1 FROM (
                            SELECT *, CASE WHEN len(z) > 0 THEN {_scaled('g1', 'range(1, o + 2)', '(o + 2)')} ELSE [] END AS m00 FROM (
                              SELECT *, {_cross_products('z', '(o + 2)')} AS g1 FROM (
                                SELECT *, (len(w) - o)::DOUBLE AS m, CASE WHEN len(w) >= 20 THEN list_transform(range(o + 1, len(w) + 1), lambda t:
                                    list_concat([1.0::DOUBLE], list_transform(range(1, o + 1), lambda i: w[t - i]), [w[t]])) ELSE [] END AS z FROM (
                                  SELECT *, CASE WHEN len(w) >= 20 THEN least(8, len(w) // 5) WHEN len(w) >= 6 THEN 2 ELSE 0 END AS o FROM (
                                    SELECT *, CASE d WHEN 0 THEN y0 WHEN 1 THEN y1 ELSE y2 END AS w FROM (
                                      SELECT *, CASE WHEN {_kpss('e0', 'len(y0)')} <= 0.463 THEN 0 WHEN {_kpss('e1', 'len(y1)')} <= 0.463 THEN 1 ELSE 2 END AS d FROM (
                                        SELECT *, list_transform(y0, lambda x: x - list_sum(y0) / len(y0)) AS e0,
                                               list_transform(y1, lambda x: x - list_sum(y1) / len(y1)) AS e1, {diff.format(a='y1')} AS y2 FROM (
                                          SELECT *, {diff.format(a='y0')} AS y1 FROM (
                                            SELECT {k}, list({value}::DOUBLE ORDER BY {index}) AS y0, max({index}) AS last FROM {src} GROUP BY {k})))))))))))))) f,
                  (VALUES {options}) x(p, q, constant)
                WHERE CASE WHEN len(f.w) >= 20 THEN f.d < 2 OR NOT x.constant WHEN f.o = 2 THEN x.p <= 2 AND x.q = 0 AND (f.d < 2 OR NOT x.constant)
                      ELSE x.p = 0 AND x.q = 0 AND x.constant END))))))))
WHERE rn = 1"""


def _arima_fold(steps: str) -> str:
    dot = lambda a, b: "(" + " + ".join(f"{a}[{i}] * {b}[{i}]" for i in (1, 2, 3)) + ")"
    newest = lambda a: "[" + ", ".join(f"CASE WHEN len({a}) >= {i} THEN {a}[len({a}) - {i - 1}] ELSE 0.0 END" for i in (1, 2, 3)) + "]"
    new = f"(c + {dot('phi', 's.w')} + {dot('theta', 's.e')} + x.draw)"
    l1 = f"CASE WHEN d = 2 THEN s.l1 + {new} ELSE {new} END"
    l0 = f"CASE WHEN d = 0 THEN {new} ELSE s.l0 + {l1} END"
    psi = f"CASE WHEN x.step = 1 THEN 1.0 ELSE CASE WHEN x.step <= 4 THEN theta[x.step - 1] ELSE 0.0 END + {dot('phi', 's.psi')} END"
    q1 = f"CASE WHEN d = 2 THEN s.q1 + {psi} ELSE {psi} END"
    q0 = f"CASE WHEN d = 0 THEN {psi} ELSE s.q0 + {q1} END"
    v = f"s.v + ({q0}) * ({q0})"
    start = (f"{{'w': {newest('w')}, 'e': {newest('resid')}, 'l1': coalesce(y1[len(y1)], 0.0), 'l0': y0[len(y0)], 'psi': [{_Z}, {_Z}, {_Z}], "
             f"'q1': {_Z}, 'q0': {_Z}, 'v': {_Z}, 'out': []::STRUCT(step BIGINT, mean DOUBLE, v DOUBLE)[]}}")
    return (f"list_reduce({steps}, lambda s, x: {{'w': [{new}, s.w[1], s.w[2]], 'e': [x.draw, s.e[1], s.e[2]], 'l1': {l1}, 'l0': {l0}, "
            f"'psi': [{psi}, s.psi[1], s.psi[2]], 'q1': {q1}, 'q0': {q0}, 'v': {v}, "
            f"'out': list_append(s.out, {{'step': x.step::BIGINT, 'mean': {l0}, 'v': {v}}})}}, {start}).out")


def arima_forecast(fit: str, keys, h: int, index: str = "Year") -> str:
    """Forecast rows from a fit table."""
    k = ", ".join(keys)
    steps = f"list_transform(range(1, {h} + 1), lambda j: {{'step': j, 'draw': 0.0::DOUBLE}})"
    return f"""
SELECT {k}, 'ARIMA' AS model, (last + x.step)::INTEGER AS {index}, x.mean AS mean, sigma2 * x.v AS variance, p, d, q, constant, aicc
FROM (SELECT *, unnest({_arima_fold(steps)}) AS x FROM {fit})"""


def arima_paths(fit: str, keys, h: int, times: int, seed, index: str = "Year") -> str:
    """DuckDB text of ``operators.arima.arima_paths``."""
    k = ", ".join(keys)
    u = md5_uniform(", ".join([*keys, "CAST(path AS VARCHAR)", "CAST(last + j AS VARCHAR)"]), seed)
    draws = f"list_transform(range(1, {h} + 1), lambda j: {{'step': j, 'draw': resid[CAST(floor({u} * len(resid)) AS BIGINT) + 1]}})"
    return f"""
SELECT {k}, path, (last + x.step)::INTEGER AS {index}, x.mean AS sim FROM (
  SELECT *, unnest({_arima_fold('draws')}) AS x FROM (
    SELECT *, {draws} AS draws FROM (SELECT *, unnest(range(1, {times} + 1))::INTEGER AS path FROM {fit})))"""
