"""§2.6 imputation queries on the annual trade panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imputation as imp
from ..sources import bindings as b
from . import sqlfrag as sf
from .registry import query
from .sqlbind import register, with_ctes

KEYS = ("Country", "flowDesc")
# Thresholds chosen inside the fixture's unit-price range (the reference's
# 5 USD/kg and 1000 kg are domain constants of its own data).
MAX_PRICE, MIN_QTY = 2200.0, 1000.0

register("price_ref", """
SELECT flowDesc, median(PrimaryValue / Qty) AS global_unit_price
FROM trade WHERE Qty > 0 AND PrimaryValue > 0 GROUP BY flowDesc""", ("trade",))

register("imp_raw", """
SELECT t.*, p.global_unit_price,
       CASE WHEN Qty IS NOT NULL AND Qty > 0 AND PrimaryValue IS NOT NULL AND PrimaryValue > 0
            THEN PrimaryValue / Qty END AS unit_price_raw
FROM trade t LEFT JOIN price_ref p USING (flowDesc)""", ("trade", "price_ref"))

register("imp_price", f"""
SELECT *, coalesce(unit_price_interp, global_unit_price) AS unit_price_final
FROM (SELECT *, {sf.chain('unit_price_raw', KEYS, 'Year')} AS unit_price_interp FROM imp_raw)""",
         ("imp_raw",))

_GUARDED = ("(Qty IS NULL OR (Qty = 0 AND PrimaryValue IS NOT NULL AND PrimaryValue > 0)) "
            "AND PrimaryValue IS NOT NULL AND unit_price_final IS NOT NULL AND unit_price_final > 0")
_STRICT = "(Qty IS NULL OR (Qty = 0 AND PrimaryValue > 0)) AND unit_price_final IS NOT NULL AND unit_price_final > 0"

register("imp_qty", f"""
SELECT *, {sf.if_else3(_GUARDED, 'PrimaryValue / unit_price_final', 'Qty')} AS Qty_filled FROM imp_price""",
         ("imp_price",))
register("imp_qty_strict", f"""
SELECT *, {sf.if_else3(_STRICT, 'PrimaryValue / unit_price_final', 'Qty')} AS Qty_filled FROM imp_price""",
         ("imp_price",))
register("imp_all", """
SELECT *, (Qty IS NULL OR Qty = 0) AND Qty_filled IS NOT NULL AS Qty_imputed_flag,
       PrimaryValue IS NULL AND PrimaryValue_filled IS NOT NULL AS Value_imputed_flag
FROM (SELECT *, CASE WHEN PrimaryValue IS NULL AND Qty_filled IS NOT NULL AND unit_price_final IS NOT NULL
                     THEN Qty_filled * unit_price_final ELSE PrimaryValue END AS PrimaryValue_filled
      FROM imp_qty)""", ("imp_qty",))

PRICE_COLS = ["Year", "CountryCode", "Country", "flowCode", "flowDesc", "Qty", "PrimaryValue",
              "global_unit_price", "unit_price_raw", "unit_price_interp", "unit_price_final"]


def _prices(spark, sf_dir):
    return imp.unit_price(b.trade_panel(spark, sf_dir), KEYS, "Year")


@query("imp_reference_price",
       with_ctes("SELECT flowDesc, global_unit_price FROM price_ref", "price_ref"),
       doubles=["global_unit_price"])
def imp_reference_price(spark, sf_dir):
    """Global median unit price per flow."""
    return imp.reference_price(b.trade_panel(spark, sf_dir))


@query("imp_unit_price",
       with_ctes(f"SELECT {', '.join(PRICE_COLS)} FROM imp_price", "imp_price"),
       doubles=["Qty", "PrimaryValue", "global_unit_price", "unit_price_raw", "unit_price_interp",
                "unit_price_final"])
def imp_unit_price(spark, sf_dir):
    """Observed price → interpolation → locf → nocb → global fallback."""
    return _prices(spark, sf_dir).select(*PRICE_COLS)


@query("imp_quantity",
       with_ctes("SELECT Year, Country, flowDesc, Qty, PrimaryValue, unit_price_final, Qty_filled FROM imp_qty",
                 "imp_qty"),
       doubles=["Qty", "PrimaryValue", "unit_price_final", "Qty_filled"])
def imp_quantity(spark, sf_dir):
    """Quantity back-calculated from value and price (guarded form)."""
    df = imp.impute_quantity(_prices(spark, sf_dir))
    return df.select("Year", "Country", "flowDesc", "Qty", "PrimaryValue", "unit_price_final", "Qty_filled")


@query("imp_quantity_strict",
       with_ctes("SELECT Year, Country, flowDesc, Qty, PrimaryValue, unit_price_final, Qty_filled "
                 "FROM imp_qty_strict", "imp_qty_strict"),
       doubles=["Qty", "PrimaryValue", "unit_price_final", "Qty_filled"])
def imp_quantity_strict(spark, sf_dir):
    """Batch form: a 0 quantity with unknown value becomes NULL."""
    df = imp.impute_quantity(_prices(spark, sf_dir), strict_na=True)
    return df.select("Year", "Country", "flowDesc", "Qty", "PrimaryValue", "unit_price_final", "Qty_filled")


@query("imp_value",
       with_ctes("SELECT Year, Country, flowDesc, PrimaryValue, Qty_filled, PrimaryValue_filled FROM imp_all",
                 "imp_all"),
       doubles=["PrimaryValue", "Qty_filled", "PrimaryValue_filled"])
def imp_value(spark, sf_dir):
    """Value := imputed quantity × price where the value is missing."""
    df = imp.impute_value(imp.impute_quantity(_prices(spark, sf_dir)))
    return df.select("Year", "Country", "flowDesc", "PrimaryValue", "Qty_filled", "PrimaryValue_filled")


@query("imp_flags",
       with_ctes("SELECT Year, CountryCode, flowDesc, Qty, Qty_filled, PrimaryValue_filled, "
                 "Qty_imputed_flag, Value_imputed_flag FROM imp_all", "imp_all"),
       doubles=["Qty", "Qty_filled", "PrimaryValue_filled"])
def imp_flags(spark, sf_dir):
    """Imputed-quantity and imputed-value flags (keyed by country code, as in the app)."""
    df = imp.impute_trade(b.trade_panel(spark, sf_dir), keys=("CountryCode", "flowDesc"))
    return df.select("Year", "CountryCode", "flowDesc", "Qty", "Qty_filled", "PrimaryValue_filled",
                     "Qty_imputed_flag", "Value_imputed_flag")


register("imp_before_after_all", """
SELECT Country, flowDesc, Year, CASE WHEN Qty > 0 THEN Qty END AS Plot_Qty,
       'Before Imputation' AS State, CAST(NULL AS BOOLEAN) AS Is_Imputed, 1 AS State_ord
FROM imp_qty_strict
UNION ALL
SELECT Country, flowDesc, Year, Qty_filled, 'After Imputation',
       (Qty IS NULL OR Qty = 0) AND Qty_filled IS NOT NULL, 2
FROM imp_qty_strict""", ("imp_qty_strict",))


@query("imp_before_after", with_ctes("SELECT * FROM imp_before_after_all", "imp_before_after_all"),
       doubles=["Plot_Qty"])
def imp_before_after(spark, sf_dir):
    """Stacked before/after table with state, imputed flag and display order."""
    from ..operators.reshape import ordered_category, union_by_name
    df = imp.impute_quantity(_prices(spark, sf_dir), strict_na=True)
    before = df.select("Country", "flowDesc", "Year",
                       F.when(F.col("Qty") > 0, F.col("Qty")).alias("Plot_Qty"),
                       F.lit("Before Imputation").alias("State"))
    after = df.select("Country", "flowDesc", "Year", F.col("Qty_filled").alias("Plot_Qty"),
                      F.lit("After Imputation").alias("State"),
                      ((F.col("Qty").isNull() | (F.col("Qty") == 0)) & F.col("Qty_filled").isNotNull())
                      .alias("Is_Imputed"))
    out = union_by_name(before, after)
    return ordered_category(out, "State", ["Before Imputation", "After Imputation"], "State_ord")


@query("imp_export",
       with_ctes("SELECT Year, CountryCode, Country, flowCode, flowDesc, Qty_filled AS Qty, PrimaryValue "
                 "FROM imp_qty_strict", "imp_qty_strict"),
       doubles=["Qty", "PrimaryValue"])
def imp_export(spark, sf_dir):
    """Forecast-ready trade: quantity replaced by the filled one, fixed column list."""
    df = imp.impute_quantity(_prices(spark, sf_dir), strict_na=True)
    return df.select("Year", "CountryCode", "Country", "flowCode", "flowDesc",
                     F.col("Qty_filled").alias("Qty"), "PrimaryValue")


register("outliers", f"""
SELECT Year, Country, flowDesc, Raw_Unit_Price, is_outlier,
       CASE WHEN is_outlier IS NULL THEN NULL WHEN is_outlier THEN NULL ELSE Qty END AS Qty,
       CASE WHEN is_outlier IS NULL THEN NULL WHEN is_outlier THEN NULL ELSE PrimaryValue END AS PrimaryValue
FROM (SELECT *, Raw_Unit_Price > {MAX_PRICE} OR Qty * 1.0 < {MIN_QTY} AS is_outlier
      FROM (SELECT Year, Country, flowDesc, Qty, PrimaryValue,
                   {sf.if_else3('Qty > 0', 'PrimaryValue / (Qty * 1.0)', '0.0')} AS Raw_Unit_Price
            FROM trade))""", ("trade",))


@query("outlier_blank", with_ctes("SELECT * FROM outliers", "outliers"),
       doubles=["Raw_Unit_Price", "Qty", "PrimaryValue"])
def outlier_blank(spark, sf_dir):
    """Price above the cap or quantity below the floor → both measures NULL."""
    df = b.trade_panel(spark, sf_dir).select("Year", "Country", "flowDesc", "Qty", "PrimaryValue")
    return imp.blank_outliers(df, max_price=MAX_PRICE, min_qty=MIN_QTY)
