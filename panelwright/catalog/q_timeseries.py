"""§2.6 gap filling and interpolation on the monthly trade panel (real gaps)."""

from __future__ import annotations

from ..operators import timeseries as ts
from ..sources import bindings as b
from . import sqlfrag as sf
from .registry import query
from .sqlbind import register, with_ctes

KEYS = ["Country", "flowDesc"]
IDX = "Year"  # monthly index year*12 + month

register("trade_m_filled", """
SELECT g.Country, g.flowDesc, g.Year, t.CountryCode, t.flowCode, t.Qty, t.PrimaryValue
FROM (SELECT Country, flowDesc, CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS Year
      FROM (SELECT Country, flowDesc, min(Year) AS lo, max(Year) AS hi FROM trade_m GROUP BY 1, 2)) g
LEFT JOIN trade_m t ON g.Country = t.Country AND g.flowDesc = t.flowDesc AND g.Year = t.Year""", ("trade_m",))


def _monthly(spark, sf_dir):
    return b.trade_panel(spark, sf_dir, monthly=True)


def _filled(spark, sf_dir):
    return ts.fill_gaps(_monthly(spark, sf_dir), KEYS, IDX)


@query("ts_fill_gaps", with_ctes("SELECT * FROM trade_m_filled", "trade_m_filled"),
       doubles={"Qty": 6, "PrimaryValue": 4})
def ts_fill_gaps(spark, sf_dir):
    """Insert the missing months of each series between its own first and last month."""
    return _filled(spark, sf_dir)


@query("ts_interp_year", with_ctes(f"""
SELECT Country, flowDesc, Year, Qty, {sf.interp('Qty', KEYS, IDX)} AS Qty_interp FROM trade_m_filled""",
    "trade_m_filled"), doubles={"Qty": 6, "Qty_interp": 6})
def ts_interp_year(spark, sf_dir):
    """Linear interpolation of interior gaps with the index as x."""
    df = _filled(spark, sf_dir).select(*KEYS, IDX, "Qty")
    return ts.interpolate(df, KEYS, IDX, "Qty", out="Qty_interp")


@query("ts_interp_position", with_ctes(f"""
SELECT Country, flowDesc, Year, Qty, {sf.interp('Qty', KEYS, IDX, x='pos')} AS Qty_interp
FROM (SELECT *, row_number() OVER (PARTITION BY Country, flowDesc ORDER BY Year) AS pos FROM trade_m)""",
    "trade_m"), doubles={"Qty": 6, "Qty_interp": 6})
def ts_interp_position(spark, sf_dir):
    """Interpolation with the row position as x (no gap filling first)."""
    df = _monthly(spark, sf_dir).select(*KEYS, IDX, "Qty")
    return ts.interpolate_position(df, KEYS, IDX, "Qty", out="Qty_interp")


@query("ts_interp_rule2", with_ctes(f"""
SELECT Country, flowDesc, Year, Qty,
       coalesce({sf.interp('Qty', KEYS, IDX)}, {sf.prev_val('Qty', KEYS, IDX)}, {sf.next_val('Qty', KEYS, IDX)})
         AS Qty_interp
FROM trade_m_filled""", "trade_m_filled"), doubles={"Qty": 6, "Qty_interp": 6})
def ts_interp_rule2(spark, sf_dir):
    """Interpolation with flat extension at both edges (rule = 2)."""
    df = _filled(spark, sf_dir).select(*KEYS, IDX, "Qty")
    return ts.interpolate(df, KEYS, IDX, "Qty", out="Qty_interp", rule=2)


@query("ts_locf", with_ctes(f"""
SELECT Country, flowDesc, Year, Qty, {sf.prev_val('Qty', KEYS, IDX)} AS Qty_locf FROM trade_m_filled""",
    "trade_m_filled"), doubles={"Qty": 6, "Qty_locf": 6})
def ts_locf(spark, sf_dir):
    """Last observation carried forward."""
    df = _filled(spark, sf_dir).select(*KEYS, IDX, "Qty")
    return ts.locf(df, KEYS, IDX, "Qty", out="Qty_locf")


@query("ts_nocb", with_ctes(f"""
SELECT Country, flowDesc, Year, Qty, {sf.next_val('Qty', KEYS, IDX)} AS Qty_nocb FROM trade_m_filled""",
    "trade_m_filled"), doubles={"Qty": 6, "Qty_nocb": 6})
def ts_nocb(spark, sf_dir):
    """Next observation carried backward."""
    df = _filled(spark, sf_dir).select(*KEYS, IDX, "Qty")
    return ts.nocb(df, KEYS, IDX, "Qty", out="Qty_nocb")


@query("ts_fill_chain", with_ctes(f"""
SELECT Country, flowDesc, Year, Qty, PrimaryValue,
       {sf.chain('Qty', KEYS, IDX, final=0.0)} AS Qty_filled,
       {sf.chain('PrimaryValue', KEYS, IDX, final=0.0)} AS Value_filled
FROM trade_m_filled""", "trade_m_filled"),
       doubles={"Qty": 6, "PrimaryValue": 4, "Qty_filled": 6, "Value_filled": 4})
def ts_fill_chain(spark, sf_dir):
    """gaps → interpolation → locf → nocb → 0, both measures in one window pass."""
    df = _filled(spark, sf_dir).select(*KEYS, IDX, "Qty", "PrimaryValue")
    return df.withColumns({"Qty_filled": ts.fill_chain_expr("Qty", KEYS, IDX, final=0.0),
                           "Value_filled": ts.fill_chain_expr("PrimaryValue", KEYS, IDX, final=0.0)})
