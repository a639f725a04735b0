"""The fixture derivations of ``sources.bindings`` as DuckDB SQL.

``with_ctes(body, *names)`` prefixes a query body with the CTEs it needs (and
their dependencies, in order).  Tables ``lineitem orders supplier nation
region customer`` are views registered by the oracle runner.
"""

from __future__ import annotations

_TRADE_AGG = """
SELECT CAST({period} AS INTEGER) AS Year, n.n_nationkey AS nk, n.n_name AS Country,
       l.l_linestatus AS st, sum(l.l_quantity) AS q, sum(l.l_extendedprice) AS v
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY 1, 2, 3, 4"""

_TRADE = """
SELECT Year, 'N' || CAST(nk AS VARCHAR) AS CountryCode, Country,
       CASE WHEN st = 'F' THEN 'M' ELSE 'X' END AS flowCode,
       CASE WHEN st = 'F' THEN 'Import' ELSE 'Export' END AS flowDesc,
       CAST(CASE WHEN (Year + nk) % 3 = 0 THEN NULL WHEN (Year + nk) % 5 = 0 THEN 0.0 ELSE q END AS DOUBLE) AS Qty,
       CAST(CASE WHEN (Year + nk) % 7 = 0 THEN NULL ELSE v END AS DOUBLE) AS PrimaryValue
FROM {src}"""

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "trade_agg": (_TRADE_AGG.format(period="year(o.o_orderdate)"), ()),
    "trade": (_TRADE.format(src="trade_agg"), ("trade_agg",)),
    "trade_m_agg": (_TRADE_AGG.format(period="year(o.o_orderdate) * 12 + month(o.o_orderdate)"), ()),
    "trade_m": (_TRADE.format(src="trade_m_agg"), ("trade_m_agg",)),
    "recycling_wide": ("""
SELECT r.r_name AS LOCATION_CODES, CAST(year(o.o_orderdate) AS INTEGER) AS TIME_PERIOD,
       sum(l.l_extendedprice) / 1e6 AS "TOTAL",
       sum(CASE WHEN l.l_returnflag = 'R' THEN l.l_extendedprice ELSE 0.0 END) / 1e6 AS "REC",
       sum(CASE WHEN l.l_returnflag = 'N' THEN l.l_extendedprice ELSE 0.0 END) / 1e6 AS "LAND"
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY 1, 2""", ()),
    "recycling": ("""
SELECT LOCATION_CODES, upper(substr(LOCATION_CODES, 1, 1)) || lower(substr(LOCATION_CODES, 2)) AS Location,
       TIME_PERIOD, PLASTICS_CODES, OBS_VALUE
FROM recycling_wide UNPIVOT INCLUDE NULLS (OBS_VALUE FOR PLASTICS_CODES IN ("TOTAL", "REC", "LAND"))""",
                  ("recycling_wide",)),
    "gdp": ("""
SELECT 'N' || CAST(g.c_nationkey AS VARCHAR) AS WB_Code, n.n_name AS Country, g.Year, g.GDP
FROM (SELECT c.c_nationkey, CAST(year(o.o_orderdate) AS INTEGER) AS Year, sum(o.o_totalprice) AS GDP
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2) g
JOIN nation n ON g.c_nationkey = n.n_nationkey""", ()),
    "country_bridge": ("""
SELECT n.n_name AS Country, r.r_name AS OECD_Code,
       CASE WHEN n.n_nationkey % 11 = 0 THEN NULL ELSE 'N' || CAST(n.n_nationkey AS VARCHAR) END AS WB_Code,
       CASE WHEN n.n_nationkey % 11 = 0 THEN NULL ELSE n.n_name END AS WB_Name
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT n.n_name || ' (former)', r.r_name,
       CASE WHEN n.n_nationkey % 11 = 0 THEN NULL ELSE 'N' || CAST(n.n_nationkey AS VARCHAR) END,
       CASE WHEN n.n_nationkey % 11 = 0 THEN NULL ELSE n.n_name END
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE n.n_nationkey % 8 = 0""", ()),
    "oecd_mapping": ("""
SELECT CASE WHEN n.n_nationkey % 3 = 1 THEN upper(substr(n.n_name, 1, 1)) || lower(substr(n.n_name, 2))
            ELSE n.n_name END AS Country, r.r_name AS OECD_Code
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""", ()),
    "name_fixes": ("""
SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS alias, n_name AS canonical
FROM nation WHERE n_nationkey % 2 = 1
UNION ALL
SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)), n_name FROM nation WHERE n_nationkey = 1""", ()),
    "wb_countries": ("SELECT DISTINCT Country AS Join_Name, WB_Code, Country AS WB_Name FROM gdp", ("gdp",)),
}


def register(name: str, sql: str, deps: tuple[str, ...] = ()) -> None:
    CTES[name] = (sql, tuple(deps))


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in CTES[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_ctes(body: str, *names: str) -> str:
    order = _order(names)
    if not order:
        return body.strip()
    parts = [f"{n} AS ({CTES[n][0].strip()})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
