"""§2.7 reshape and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape as rs
from ..plans import prescriptive as pr
from ..sources import bindings as b
from .common import WASTE_DIGITS, trade, trade_and_totals, waste
from .registry import query
from .sqlbind import with_ctes

WIDE_VARS = ["Est_Waste_Produced", "Est_Recycled_Amount", "Regional_Recycling_Rate", "Imports", "Exports",
             "Import_Value", "Export_Value"]


@query("pivot_single", with_ctes("""
SELECT Location, LOCATION_CODES, TIME_PERIOD,
       max(CASE WHEN PLASTICS_CODES = 'TOTAL' THEN OBS_VALUE END) AS "TOTAL",
       max(CASE WHEN PLASTICS_CODES = 'REC' THEN OBS_VALUE END) AS "REC"
FROM recycling WHERE PLASTICS_CODES IN ('REC', 'TOTAL') GROUP BY 1, 2, 3""", "recycling"),
       doubles={"TOTAL": 6, "REC": 6})
def pivot_single(spark, sf_dir):
    """One value column spread by code, explicit value list."""
    r = b.recycling(spark, sf_dir).where(F.col("PLASTICS_CODES").isin("REC", "TOTAL"))
    return rs.pivot_single(r, ["Location", "LOCATION_CODES", "TIME_PERIOD"], "PLASTICS_CODES", "OBS_VALUE",
                           ["TOTAL", "REC"])


@query("pivot_multi_fill", with_ctes("SELECT * FROM trade_wide", "trade_wide"),
       doubles={k: WASTE_DIGITS[k] for k in ("Imports", "Exports", "Import_Value", "Export_Value")})
def pivot_multi_fill(spark, sf_dir):
    """Quantity and value by flow code, 0-filled, renamed to Imports/Exports/…"""
    return pr.trade_wide(trade(spark, sf_dir))


KG_VARS = {"Est_Waste_Produced_Kg": "Est_Waste_Produced", "Est_Recycled_Amount_Kg": "Est_Recycled_Amount",
           "Imports_Kg": "Imports", "Exports_Kg": "Exports"}
LONG_VARS = [*KG_VARS, "Import_Value", "Export_Value", "Regional_Recycling_Rate"]


@query("unpivot_long", with_ctes("""
SELECT Country, Year, Variable, Amount FROM (
  SELECT Country, Year, """ + ", ".join(f"{v} * 1e9 AS {k}" for k, v in KG_VARS.items())
    + """, Import_Value, Export_Value, Regional_Recycling_Rate FROM waste)
UNPIVOT INCLUDE NULLS (Amount FOR Variable IN (""" + ", ".join(LONG_VARS) + "))", "waste"),
       doubles={"Amount": "sig10"})
def unpivot_long(spark, sf_dir):
    """Seven wide columns (quantities in kg) to (Variable, Amount); NULLs kept."""
    w = waste(spark, sf_dir).select("Country", "Year", *[(F.col(v) * 1e9).alias(k) for k, v in KG_VARS.items()],
                                    "Import_Value", "Export_Value", "Regional_Recycling_Rate")
    return rs.unpivot_long(w, ["Country", "Year"], LONG_VARS, "Variable", "Amount")


@query("complete_grid", with_ctes("""
SELECT c.Country, y.Year, f.flowDesc, coalesce(t.Qty, 0.0) AS Qty
FROM (SELECT DISTINCT Country FROM trade WHERE Qty IS NOT NULL) c
CROSS JOIN (SELECT DISTINCT Year FROM trade WHERE Qty IS NOT NULL) y
CROSS JOIN (SELECT DISTINCT flowDesc FROM trade WHERE Qty IS NOT NULL) f
LEFT JOIN (SELECT Country, Year, flowDesc, Qty FROM trade WHERE Qty IS NOT NULL) t
  ON c.Country = t.Country AND y.Year = t.Year AND f.flowDesc = t.flowDesc""", "trade"), doubles={"Qty": 6})
def complete_grid(spark, sf_dir):
    """Every Country × Year × flow of the observed rows; missing combinations get 0."""
    obs = trade(spark, sf_dir).where(F.col("Qty").isNotNull()).select("Country", "Year", "flowDesc", "Qty")
    return rs.complete_grid(obs, ["Country", "Year", "flowDesc"], fill={"Qty": 0.0})


@query("union_by_name", with_ctes("""
SELECT Country, Year, Imports, NULL::DOUBLE AS Exports, 'History' AS Type FROM waste
UNION ALL
SELECT Country, Year, NULL::DOUBLE, Exports, NULL FROM trade_wide""", "waste", "trade_wide"),
       doubles={"Imports": 12, "Exports": 12})
def union_by_name(spark, sf_dir):
    """bind_rows: columns matched by name, missing ones NULL."""
    t_long, totals = trade_and_totals(spark, sf_dir)
    a = waste(spark, sf_dir, t_long, totals).select("Country", "Year", "Imports", F.lit("History").alias("Type"))
    c = pr.trade_wide(t_long).select("Exports", "Year", "Country")
    return rs.union_by_name(a, c)


@query("union_distinct_keys", with_ctes("""
SELECT Country FROM trade UNION SELECT Country FROM country_bridge""", "trade", "country_bridge"))
def union_distinct_keys(spark, sf_dir):
    """Unique names over the trade panel and the bridge."""
    return rs.union_distinct(trade(spark, sf_dir).select("Country"), b.country_bridge(spark, sf_dir).select("Country"))


@query("ordered_category", with_ctes("""
SELECT Country, Year, flowDesc, CASE flowDesc WHEN 'Import' THEN 1 WHEN 'Export' THEN 2 END AS flow_ord
FROM trade""", "trade"))
def ordered_category(spark, sf_dir):
    """Fixed display order of a category as an explicit order column."""
    t = trade(spark, sf_dir).select("Country", "Year", "flowDesc")
    return rs.ordered_category(t, "flowDesc", ["Import", "Export"], "flow_ord")
