"""Prescriptive dataset: regional totals split to countries by GDP share,
joined to trade, with own / others processing metrics.

Plan: GDP ⋈ bridge (many-to-many, kept) → share as a window over
(region, year) → ⋈ regional rates → ⟕ wide trade → metrics.  Every join key
is a (country|region, year) pair; the fact-sized input (trade lines) is
aggregated to that grain before it meets anything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from ..operators.aggregate import share_of_total
from ..operators.reshape import pivot_multi
from ..sources import bindings as b

MT = 1e9  # kg per million tonnes


def gdp_clean(gdp: DataFrame, bridge: DataFrame, dedupe_codes: bool = False) -> DataFrame:
    """GDP rows joined to the bridge on WB code.  Aliased names duplicate GDP
    rows on purpose (reference behaviour); ``dedupe_codes`` keeps one name
    per code."""
    br = bridge.select("Country", "WB_Code", "OECD_Code")
    if dedupe_codes:
        br = br.groupBy("WB_Code").agg(F.min("Country").alias("Country"), F.min("OECD_Code").alias("OECD_Code"))
    g = gdp.select("WB_Code", "Year", "GDP")
    return g.join(br, on="WB_Code", how="inner").select("Country", "WB_Code", "OECD_Code", "Year", "GDP")


def gdp_shares(clean: DataFrame) -> DataFrame:
    return share_of_total(clean, ["OECD_Code", "Year"], "GDP", "GDP_Share").select(
        "Country", "OECD_Code", "Year", "GDP_Share")


def regional_rates(recycling: DataFrame) -> DataFrame:
    """TOTAL/REC to columns, recycling rate = REC / TOTAL."""
    r = recycling.where(F.col("PLASTICS_CODES").isin("TOTAL", "REC"))
    w = pivot_multi(r, ["LOCATION_CODES", "TIME_PERIOD"], "PLASTICS_CODES", ["OBS_VALUE"],
                    ["TOTAL", "REC"], agg="first", sep="_")
    return w.select(F.col("LOCATION_CODES").alias("OECD_Code"), F.col("TIME_PERIOD").alias("Year"),
                    F.col("OBS_VALUE_TOTAL").alias("Region_Waste_Produced"),
                    F.col("OBS_VALUE_REC").alias("Region_Recycled_Amount"),
                    safe_div("OBS_VALUE_REC", "OBS_VALUE_TOTAL").alias("Regional_Recycling_Rate"))


def country_estimates(shares: DataFrame, rates: DataFrame) -> DataFrame:
    j = shares.join(rates, on=["OECD_Code", "Year"], how="inner")
    est = F.col("Region_Waste_Produced") * F.col("GDP_Share")
    return j.select("Country", "Year", est.alias("Est_Waste_Produced"),
                    (est * F.col("Regional_Recycling_Rate")).alias("Est_Recycled_Amount"),
                    "Regional_Recycling_Rate")


def trade_wide(trade: DataFrame, qty_scale: float = MT) -> DataFrame:
    """Quantity (÷ scale) and value by flow code → Imports/Exports columns, 0-filled."""
    t = trade.withColumn("Qty", F.col("Qty") / F.lit(qty_scale))
    w = pivot_multi(t, ["Country", "Year"], "flowCode", ["Qty", "PrimaryValue"], ["M", "X"],
                    agg="sum", fill=0.0)
    return w.select("Country", "Year", F.col("Qty_M").alias("Imports"), F.col("Qty_X").alias("Exports"),
                    F.col("PrimaryValue_M").alias("Import_Value"), F.col("PrimaryValue_X").alias("Export_Value"))


def waste_processing(est: DataFrame, trade_w: DataFrame, guard: str = "null") -> DataFrame:
    """Own = recycled − exports, others = imports, % own of waste produced.

    ``guard``: what a zero denominator gives — ``"null"`` (R's Inf is not a
    value Spark keeps) or ``"zero"`` (the forecasting script's guard).
    """
    j = est.join(trade_w, on=["Country", "Year"], how="left").fillna(
        0.0, subset=["Imports", "Exports", "Import_Value", "Export_Value"])
    own = F.col("Est_Recycled_Amount") - F.col("Exports")
    pct = safe_div(own, F.col("Est_Waste_Produced")) * 100
    if guard == "zero":
        pct = F.when(F.col("Est_Waste_Produced") > 0, pct).otherwise(F.lit(0.0))
    return (j.withColumn("Processed_Own_Waste", own)
             .withColumn("Processed_Others_Waste", F.col("Imports"))
             .withColumn("Percent_Own_Processed", pct))


def prescriptive_dataset(spark, sf_dir: str, dedupe_codes: bool = False,
                         trade: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """E2 end to end from the driver tables (the ``waste`` fixture); pass
    ``totals`` (``nation_totals``) and ``trade`` when the caller already holds
    them, so that the fact join is not run again."""
    totals = totals if totals is not None else b.nation_totals(spark, sf_dir)
    shares = gdp_shares(gdp_clean(b.gdp(spark, sf_dir), b.country_bridge(spark, sf_dir), dedupe_codes))
    est = country_estimates(shares, regional_rates(b.recycling(spark, sf_dir, totals)))
    # read once here, so no need to write the panel first
    trade = trade if trade is not None else b.trade_panel(spark, sf_dir, materialized=False, totals=totals)
    return waste_processing(est, trade_wide(trade))
