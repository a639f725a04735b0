"""Shared fixtures of the catalog: the prescriptive (E2) chain on both sides."""

from __future__ import annotations

import os
import uuid

from ..plans import prescriptive as pr
from ..session import ensure_checkpoint_dir
from ..sources import bindings as b
from .sqlbind import register

register("gdp_clean", """
SELECT br.Country, g.WB_Code, br.OECD_Code, g.Year, g.GDP
FROM gdp g JOIN country_bridge br ON g.WB_Code = br.WB_Code""", ("gdp", "country_bridge"))
register("gdp_shares", """
SELECT Country, OECD_Code, Year, GDP / nullif(sum(GDP) OVER (PARTITION BY OECD_Code, Year), 0) AS GDP_Share
FROM gdp_clean""", ("gdp_clean",))
register("regional", """
SELECT OECD_Code, Year, Region_Waste_Produced, Region_Recycled_Amount,
       Region_Recycled_Amount / nullif(Region_Waste_Produced, 0) AS Regional_Recycling_Rate
FROM (SELECT LOCATION_CODES AS OECD_Code, TIME_PERIOD AS Year,
             max(CASE WHEN PLASTICS_CODES = 'TOTAL' THEN OBS_VALUE END) AS Region_Waste_Produced,
             max(CASE WHEN PLASTICS_CODES = 'REC' THEN OBS_VALUE END) AS Region_Recycled_Amount
      FROM recycling WHERE PLASTICS_CODES IN ('TOTAL', 'REC') GROUP BY 1, 2)""", ("recycling",))
register("country_est", """
SELECT s.Country, s.Year, r.Region_Waste_Produced * s.GDP_Share AS Est_Waste_Produced,
       r.Region_Waste_Produced * s.GDP_Share * r.Regional_Recycling_Rate AS Est_Recycled_Amount,
       r.Regional_Recycling_Rate
FROM gdp_shares s JOIN regional r ON s.OECD_Code = r.OECD_Code AND s.Year = r.Year""",
         ("gdp_shares", "regional"))
register("trade_wide", """
SELECT Country, Year,
       coalesce(sum(CASE WHEN flowCode = 'M' THEN Qty / 1e9 END), 0.0) AS Imports,
       coalesce(sum(CASE WHEN flowCode = 'X' THEN Qty / 1e9 END), 0.0) AS Exports,
       coalesce(sum(CASE WHEN flowCode = 'M' THEN PrimaryValue END), 0.0) AS Import_Value,
       coalesce(sum(CASE WHEN flowCode = 'X' THEN PrimaryValue END), 0.0) AS Export_Value
FROM trade GROUP BY 1, 2""", ("trade",))
register("waste", """
SELECT *, Est_Recycled_Amount - Exports AS Processed_Own_Waste, Imports AS Processed_Others_Waste,
       (Est_Recycled_Amount - Exports) / nullif(Est_Waste_Produced, 0) * 100 AS Percent_Own_Processed
FROM (SELECT e.Country, e.Year, e.Est_Waste_Produced, e.Est_Recycled_Amount, e.Regional_Recycling_Rate,
             coalesce(t.Imports, 0.0) AS Imports, coalesce(t.Exports, 0.0) AS Exports,
             coalesce(t.Import_Value, 0.0) AS Import_Value, coalesce(t.Export_Value, 0.0) AS Export_Value
      FROM country_est e LEFT JOIN trade_wide t ON e.Country = t.Country AND e.Year = t.Year)""",
         ("country_est", "trade_wide"))

# Rounding of the waste table's columns (Mt quantities are ~1e-6, values ~1e6).
WASTE_DIGITS = {"Est_Waste_Produced": 9, "Est_Recycled_Amount": 9, "Regional_Recycling_Rate": 9,
                "Imports": 12, "Exports": 12, "Import_Value": 4, "Export_Value": 4,
                "Processed_Own_Waste": 9, "Processed_Others_Waste": 12, "Percent_Own_Processed": 7}


def waste(spark, sf_dir, trade=None, totals=None):
    return pr.prescriptive_dataset(spark, sf_dir, trade=trade, totals=totals)


def trade(spark, sf_dir, totals=None):
    """The panel for queries that read it more than once (written first)."""
    return b.trade_panel(spark, sf_dir, totals=totals)


def trade_and_totals(spark, sf_dir):
    """The panel and the totals that ``waste`` takes, from one fact join."""
    totals = b.nation_totals(spark, sf_dir)
    return trade(spark, sf_dir, totals), totals


def trade_once(spark, sf_dir, years=None):
    """The panel for queries that read it once (nothing is written)."""
    return b.trade_panel(spark, sf_dir, materialized=False, years=years)


def scratch_path(spark, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (shared storage
    on a cluster) for queries that write and read back."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "panelwright-scratch", f"{name}-{uuid.uuid4().hex}")
