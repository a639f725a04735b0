"""§2.10 domain compositions: prescriptive dataset (E2), forecast system (E1)
and the app's data feeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import relational as rel
from ..operators.reshape import complete_grid, pivot_multi, pivot_single, unpivot_long
from ..plans import forecast_system as fs
from ..plans import prescriptive as pr
from ..session import cut_lineage
from ..sources import bindings as b
from . import sqlfrag as sf
from .common import WASTE_DIGITS, trade, trade_and_totals, waste
from .q_joins import bridge_built
from .registry import query
from .sqlbind import register, with_ctes

# Thresholds inside the fixture's ranges (reference constants: 5 USD/kg, 1000 kg, cap 2.50).
E1 = {"max_price": 2200.0, "min_qty": 1000.0, "min_kg": 1000.0, "price_cap": 2100.0}
SEEDS = (123, 124, 7)
HE = 20
VARS = fs.VARS
KG_COLS = ["Est_Recycled_Amount_Kg", "Est_Waste_Produced_Kg", "Exports_Kg", "Imports_Kg"]

# --- E2 -------------------------------------------------------------------------------------


@query("dom_name_bridge", with_ctes("SELECT Country, OECD_Code, WB_Code, WB_Name FROM bridge_built", "bridge_built"))
def dom_name_bridge(spark, sf_dir):
    """Local names → canonical → WB code (region kept); unmatched rows have NULL codes."""
    return bridge_built(spark, sf_dir).select("Country", "OECD_Code", "WB_Code", "WB_Name")


@query("dom_regional_rates", with_ctes("SELECT * FROM regional", "regional"),
       doubles={"Region_Waste_Produced": 6, "Region_Recycled_Amount": 6, "Regional_Recycling_Rate": 9})
def dom_regional_rates(spark, sf_dir):
    """TOTAL / REC per region and year with the recycling rate."""
    return pr.regional_rates(b.recycling(spark, sf_dir))


@query("dom_region_totals", with_ctes("""
SELECT LOCATION_CODES, TIME_PERIOD, OBS_VALUE FROM recycling WHERE PLASTICS_CODES = 'TOTAL'""", "recycling"),
       doubles={"OBS_VALUE": 6})
def dom_region_totals(spark, sf_dir):
    """Total waste produced per region and year (TOTAL rows only)."""
    return b.recycling(spark, sf_dir).where(F.col("PLASTICS_CODES") == "TOTAL").select(
        "LOCATION_CODES", "TIME_PERIOD", "OBS_VALUE")


@query("dom_gdp_disaggregate", with_ctes("SELECT * FROM country_est", "country_est"),
       doubles={"Est_Waste_Produced": 9, "Est_Recycled_Amount": 9, "Regional_Recycling_Rate": 9})
def dom_gdp_disaggregate(spark, sf_dir):
    """Regional totals split to countries by GDP share."""
    shares = pr.gdp_shares(pr.gdp_clean(b.gdp(spark, sf_dir), b.country_bridge(spark, sf_dir)))
    return pr.country_estimates(shares, pr.regional_rates(b.recycling(spark, sf_dir)))


@query("dom_trade_wide", with_ctes("SELECT * FROM trade_wide", "trade_wide"),
       doubles={k: WASTE_DIGITS[k] for k in ("Imports", "Exports", "Import_Value", "Export_Value")})
def dom_trade_wide(spark, sf_dir):
    """Quantity (Mt) and value by flow, 0-filled."""
    return pr.trade_wide(trade(spark, sf_dir))


@query("dom_waste_processing", with_ctes("SELECT * FROM waste", "waste"), doubles=WASTE_DIGITS)
def dom_waste_processing(spark, sf_dir):
    """The prescriptive dataset: estimates ⟕ trade with own/others processing and % own."""
    return waste(spark, sf_dir)


# --- E1 SQL -----------------------------------------------------------------------------------

_MP, _MQ, _MK, _CAP = E1["max_price"], E1["min_qty"], E1["min_kg"], E1["price_cap"]
register("e_tl", """
SELECT Country, Year, Imports AS Qty, Import_Value AS PrimaryValue, 'Import' AS flowDesc FROM waste
UNION ALL SELECT Country, Year, Exports, Export_Value, 'Export' FROM waste""", ("waste",))
register("e_blank", f"""
SELECT Country, Year, flowDesc,
       CASE WHEN is_out IS NULL THEN NULL WHEN is_out THEN NULL ELSE Qty END AS Qty,
       CASE WHEN is_out IS NULL THEN NULL WHEN is_out THEN NULL ELSE PrimaryValue END AS PrimaryValue
FROM (SELECT *, Raw_Unit_Price > {_MP} OR Qty * 1e9 < {_MQ} AS is_out
      FROM (SELECT *, {sf.if_else3('Qty > 0', 'PrimaryValue / (Qty * 1e9)', '0.0')} AS Raw_Unit_Price FROM e_tl))""",
         ("e_tl",))
register("e_price", f"""
SELECT *, coalesce(unit_price_interp, global_unit_price) AS unit_price_final FROM (
  SELECT *, {sf.chain('unit_price_raw', ['Country', 'flowDesc'], 'Year')} AS unit_price_interp FROM (
    SELECT t.*, p.global_unit_price,
           CASE WHEN Qty IS NOT NULL AND Qty > 0 AND PrimaryValue IS NOT NULL AND PrimaryValue > 0
                THEN PrimaryValue / Qty END AS unit_price_raw
    FROM e_blank t LEFT JOIN (
      SELECT flowDesc, median(PrimaryValue / Qty) AS global_unit_price FROM e_blank
      WHERE Qty IS NOT NULL AND Qty > 0 AND PrimaryValue > 0 GROUP BY flowDesc) p USING (flowDesc)))""",
         ("e_blank",))
_STRICT = "(Qty IS NULL OR (Qty = 0 AND PrimaryValue > 0)) AND unit_price_final IS NOT NULL AND unit_price_final > 0"
register("e_hist", f"""
SELECT *, round(Est_Recycled_Amount * 1e9, 2) AS Est_Recycled_Amount_Kg,
       round(Est_Waste_Produced * 1e9, 2) AS Est_Waste_Produced_Kg,
       round(Exports * 1e9, 2) AS Exports_Kg, round(Imports * 1e9, 2) AS Imports_Kg FROM (
  SELECT b.Country, b.Year, b.Est_Waste_Produced, b.Est_Recycled_Amount,
         round(coalesce(b.Regional_Recycling_Rate, 0.0), 9) AS Regional_Recycling_Rate,
         coalesce(w.Imports, 0.0) AS Imports, coalesce(w.Exports, 0.0) AS Exports,
         round(coalesce(w.Import_Value, 0.0), 2) AS Import_Value, round(coalesce(w.Export_Value, 0.0), 2) AS Export_Value
  FROM waste b LEFT JOIN (
    SELECT Country, Year, max(CASE WHEN flowDesc = 'Import' THEN Qty_filled END) AS Imports,
           max(CASE WHEN flowDesc = 'Export' THEN Qty_filled END) AS Exports,
           max(CASE WHEN flowDesc = 'Import' THEN PrimaryValue END) AS Import_Value,
           max(CASE WHEN flowDesc = 'Export' THEN PrimaryValue END) AS Export_Value
    FROM (SELECT *, {sf.if_else3(_STRICT, 'PrimaryValue / unit_price_final', 'Qty')} AS Qty_filled FROM e_price)
    GROUP BY 1, 2) w ON b.Country = w.Country AND b.Year = w.Year)""", ("waste", "e_price"))
register("e_fin", f"""
SELECT Country, Variable, Year, {sf.chain('Amount', ['Country', 'Variable'], 'Year', final=0.0)} AS Amount FROM (
  SELECT g.Country, g.Variable, g.Year, l.Amount FROM (
    SELECT Country, Variable, CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS Year
    FROM (SELECT Country, Variable, min(Year) AS lo, max(Year) AS hi FROM e_long GROUP BY 1, 2)) g
  LEFT JOIN e_long l ON g.Country = l.Country AND g.Variable = l.Variable AND g.Year = l.Year)""", ("e_long",))
register("e_long", f"""
SELECT Country, Year, Variable, Amount FROM (SELECT Country, Year, {', '.join(VARS)} FROM e_hist)
UNPIVOT INCLUDE NULLS (Amount FOR Variable IN ({', '.join(VARS)}))""", ("e_hist",))
register("e_paths_a", sf.residual_paths("e_fin", ["Country", "Variable"], "Amount", "Year", HE, 1, SEEDS[0], "NAIVE"),
         ("e_fin",))
register("e_paths_b", sf.residual_paths("e_fin", ["Country", "Variable"], "Amount", "Year", HE, 1, SEEDS[1], "NAIVE"),
         ("e_fin",))


register("e_fit", sf.arima_fit("e_fin", ["Country", "Variable"], "Amount"), ("e_fin",))


def _arima_ctes(name: str) -> str:
    """The CTEs of a forecast-file query with ARIMA paths in place of the naive ones."""
    keys = ["Country", "Variable"]
    text = with_ctes(f"SELECT * FROM {name}", "e_fit", name)
    for seed in SEEDS[:2]:
        naive = sf.residual_paths("e_fin", keys, "Amount", "Year", HE, 1, seed, "NAIVE").strip()
        text = text.replace(naive, sf.arima_paths("e_fit", keys, HE, 1, seed).strip())
    return text


def _wide_sql(src, value):
    return ", ".join(f"max(CASE WHEN Variable = '{v}' THEN {value} END) AS {v}" for v in VARS)


_OWN = "Est_Recycled_Amount_Kg - Exports_Kg"
_PCT = sf.if_else3("Est_Waste_Produced_Kg > 0", f"({_OWN}) / Est_Waste_Produced_Kg * 100", "0.0")
register("e_self", f"""
SELECT Country, Year, 'History' AS Type, {_PCT} AS Self_Sufficiency FROM e_hist
UNION ALL
SELECT Country, Year, 'Forecast', {_PCT} FROM (
  SELECT Country, Year, {_wide_sql('p', 'Amount')} FROM (
    SELECT Country, Year, Variable, CASE WHEN sim IS NOT NULL THEN greatest(sim, 0.0) END AS Amount FROM e_paths_a)
  GROUP BY 1, 2)""", ("e_hist", "e_paths_a"))
_Z = sf.std_normal("p.Country, p.Variable, CAST(p.path AS VARCHAR), CAST(p.Year AS VARCHAR)", SEEDS[2])
register("e_full", f"""
SELECT Country, Year, {', '.join(VARS)}, {_OWN} AS Processed_Own_Waste, Imports_Kg AS Processed_Others_Waste,
       {_PCT} AS Percent_Own_Processed, 'History' AS Type FROM e_hist
UNION ALL
SELECT Country, Year, {', '.join(VARS)}, {_OWN}, Imports_Kg, {_PCT}, 'Forecast' FROM (
  SELECT Country, Year, {_wide_sql('c', 'Amount')} FROM (
    SELECT c.Country, y.Year, v.Variable,
           CASE WHEN v.Variable = 'Regional_Recycling_Rate' AND coalesce(j.Amount, 0.0) IS NOT NULL
                THEN least(greatest(coalesce(j.Amount, 0.0), 0.0), 100.0) ELSE coalesce(j.Amount, 0.0) END AS Amount
    FROM (SELECT DISTINCT Country FROM e_noisy) c
    CROSS JOIN (SELECT DISTINCT Year FROM e_noisy) y CROSS JOIN (SELECT DISTINCT Variable FROM e_noisy) v
    LEFT JOIN e_noisy j ON c.Country = j.Country AND y.Year = j.Year AND v.Variable = j.Variable)
  GROUP BY 1, 2)""", ("e_hist", "e_noisy"))
register("e_noisy", f"""
SELECT p.Country, p.Year, p.Variable,
       CASE WHEN p.sim + {_Z} * (CASE WHEN s.hist_sd IS NULL OR s.hist_sd = 0 THEN 0.001 ELSE s.hist_sd END) * 0.1
                 IS NOT NULL
            THEN greatest(p.sim + {_Z} * (CASE WHEN s.hist_sd IS NULL OR s.hist_sd = 0 THEN 0.001 ELSE s.hist_sd END)
                          * 0.1, 0.0) END AS Amount
FROM e_paths_b p LEFT JOIN (SELECT Country, Variable, stddev_samp(Amount) AS hist_sd FROM e_fin GROUP BY 1, 2) s
  ON p.Country = s.Country AND p.Variable = s.Variable""", ("e_paths_b", "e_fin"))
register("e_gp", f"""
SELECT Year, median(Import_Value / Imports_Kg) AS Global_Avg_Price FROM e_full WHERE Imports_Kg > {_MK} GROUP BY Year""",
         ("e_full",))
# a country's year may be both history and forecast: history first
_T = "Year * 2 + (CASE WHEN Type = 'History' THEN 0 ELSE 1 END)"
_TF = _T.replace("Year", "f.Year").replace("Type", "f.Type")
register("e_ind", f"""
SELECT *, (Processed_Own_Waste + Processed_Others_Waste) * Smoothed_Price AS Local_Industry_Value FROM (
  SELECT *, CASE WHEN rn >= 3 THEN full3 ELSE first_value(CASE WHEN rn = 3 THEN full3 END IGNORE NULLS)
              OVER (PARTITION BY Country ORDER BY {_T} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END
            AS Smoothed_Price FROM (
    SELECT *, row_number() OVER (PARTITION BY Country ORDER BY {_T}) AS rn,
           CASE WHEN count(Final_Price) OVER w3 = 3 THEN avg(Final_Price) OVER w3 END AS full3 FROM (
      SELECT *, CASE WHEN coalesce(Interp_Price, Global_Avg_Price) IS NOT NULL
                     THEN least(coalesce(Interp_Price, Global_Avg_Price), {_CAP}) END AS Final_Price FROM (
        SELECT *, {sf.chain('Raw_Price', ['Country'], _T, x='pos')} AS Interp_Price FROM (
          SELECT f.*, g.Global_Avg_Price,
                 {sf.if_else3(f'f.Imports_Kg > {_MK}', 'f.Import_Value / f.Imports_Kg', 'NULL')} AS Raw_Price,
                 row_number() OVER (PARTITION BY f.Country ORDER BY {_TF}) AS pos
          FROM e_full f LEFT JOIN e_gp g ON f.Year = g.Year)))
    WINDOW w3 AS (PARTITION BY Country ORDER BY {_T} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)))""",
         ("e_full", "e_gp"))
register("e_out", f"""
SELECT i.Country, i.Year, i.Type, {', '.join('i.' + c for c in fs.OUTPUT_COLS[3:13])}, s.Self_Sufficiency,
       i.Local_Industry_Value
FROM e_ind i LEFT JOIN e_self s ON i.Country = s.Country AND i.Year = s.Year AND i.Type = s.Type""",
         ("e_ind", "e_self"))

# Rounding of forecast-system outputs: significant digits, as the columns mix
# magnitudes and scenario paths add 20 residuals; differences of such columns
# keep fewer digits than their terms.
KGD = {c: "sig8" for c in KG_COLS}
DIFF = {"Processed_Own_Waste": "sig6", "Processed_Others_Waste": "sig8", "Percent_Own_Processed": 4}
OUT_D = {**KGD, **DIFF, "Regional_Recycling_Rate": 6, "Import_Value": 2, "Export_Value": 2, "Self_Sufficiency": 4,
         "Local_Industry_Value": "sig6"}


def e1(spark, sf_dir, model="NAIVE", wide=None):
    return fs.ForecastSystem(wide if wide is not None else waste(spark, sf_dir), h=HE, model=model, seeds=SEEDS, **E1)


@query("dom_history_kg", with_ctes("SELECT * FROM e_hist", "e_hist"),
       doubles={**{c: 0 for c in KG_COLS}, "Est_Waste_Produced": 9, "Est_Recycled_Amount": 9,
                "Regional_Recycling_Rate": 9, "Imports": 12, "Exports": 12, "Import_Value": 2, "Export_Value": 2})
def dom_history_kg(spark, sf_dir):
    """Outlier-blanked, imputed, 0-filled history with kg columns."""
    return e1(spark, sf_dir).history()


@query("dom_forecast_input", with_ctes("SELECT * FROM e_fin", "e_fin"), doubles={"Amount": "sig10"})
def dom_forecast_input(spark, sf_dir):
    """Seven series per country, gaps filled, interp → locf → nocb → 0."""
    return e1(spark, sf_dir).forecast_input()


@query("dom_self_sufficiency", with_ctes("SELECT * FROM e_self", "e_self"), doubles={"Self_Sufficiency": 4})
def dom_self_sufficiency(spark, sf_dir):
    """History and 20-year scenario self-sufficiency (%), typed union."""
    return e1(spark, sf_dir).self_sufficiency()


@query("dom_self_sufficiency_arima", _arima_ctes("e_self"), doubles={"Self_Sufficiency": 4})
def dom_self_sufficiency_arima(spark, sf_dir):
    """Same branch with automatic-ARIMA bootstrap paths (the reference's model)."""
    return e1(spark, sf_dir, "ARIMA").self_sufficiency()


@query("dom_industry_inputs", with_ctes("SELECT * FROM e_full", "e_full"),
       doubles={**KGD, **DIFF, "Regional_Recycling_Rate": 6, "Import_Value": 2, "Export_Value": 2})
def dom_industry_inputs(spark, sf_dir):
    """Noisy scenario → complete grid → rate clamp → wide → metrics, ∪ history."""
    return e1(spark, sf_dir).full()


@query("dom_global_price", with_ctes("SELECT * FROM e_gp", "e_gp"), doubles={"Global_Avg_Price": 3})
def dom_global_price(spark, sf_dir):
    """Yearly median import price over rows above the quantity floor."""
    return e1(spark, sf_dir).global_prices()


@query("dom_industry_value", with_ctes("""
SELECT Country, Year, Type, Raw_Price, Interp_Price, Global_Avg_Price, Final_Price, Smoothed_Price, Local_Industry_Value
FROM e_ind""", "e_ind"), doubles={"Raw_Price": 3, "Interp_Price": 3, "Global_Avg_Price": 3, "Final_Price": 3,
                                  "Smoothed_Price": 3, "Local_Industry_Value": "sig6"})
def dom_industry_value(spark, sf_dir):
    """Price chain per country × processed volume."""
    return e1(spark, sf_dir).industry().select("Country", "Year", "Type", "Raw_Price", "Interp_Price",
                                                 "Global_Avg_Price", "Final_Price", "Smoothed_Price",
                                                 "Local_Industry_Value")


@query("dom_best_of_both", with_ctes("SELECT * FROM e_out", "e_out"), doubles=OUT_D)
def dom_best_of_both(spark, sf_dir):
    """Industry branch ⟕ self-sufficiency branch on (Country, Year, Type): the forecast file."""
    return e1(spark, sf_dir).output()


@query("dom_best_of_both_arima", _arima_ctes("e_out"), doubles=OUT_D)
def dom_best_of_both_arima(spark, sf_dir):
    """The forecast file with automatic-ARIMA bootstrap paths in both branches."""
    return e1(spark, sf_dir, "ARIMA").output()


@query("dom_volatility_columns", with_ctes("""
SELECT *, stddev_samp(Local_Industry_Value) OVER (PARTITION BY Country) AS Vol_Industry_Value,
       stddev_samp(Self_Sufficiency) OVER (PARTITION BY Country) AS Vol_Self_Sufficiency FROM e_out""", "e_out"),
       doubles={**OUT_D, "Vol_Industry_Value": "sig6", "Vol_Self_Sufficiency": 4})
def dom_volatility_columns(spark, sf_dir):
    """Per-country sd of industry value and self-sufficiency attached to every row (window, no re-join)."""
    o = e1(spark, sf_dir).output()
    w = Window.partitionBy("Country")
    return o.withColumns({"Vol_Industry_Value": F.stddev_samp("Local_Industry_Value").over(w),
                          "Vol_Self_Sufficiency": F.stddev_samp("Self_Sufficiency").over(w)})


@query("dom_volatile_topn", with_ctes("""
SELECT o.Country, o.Year, o.Type, o.Local_Industry_Value, 'Top 5 volatile' AS label
FROM e_out o WHERE o.Country IN (
  SELECT Country FROM e_out GROUP BY Country ORDER BY stddev_samp(Local_Industry_Value) DESC NULLS LAST, Country
  LIMIT 5)""", "e_out"), doubles={"Local_Industry_Value": "sig6"})
def dom_volatile_topn(spark, sf_dir):
    """Rows of the 5 countries with the most volatile industry value, labelled."""
    o = e1(spark, sf_dir).output()
    sd = o.groupBy("Country").agg(F.stddev_samp("Local_Industry_Value").alias("sd"))
    top = rel.top_n(sd, 5, [F.col("sd").desc_nulls_last(), F.col("Country")]).select("Country")
    return rel.semi_join(o, top, "Country", bounded=True).select(
        "Country", "Year", "Type", "Local_Industry_Value", F.lit("Top 5 volatile").alias("label"))


# --- exploration feeds ----------------------------------------------------------------------

MIN_YEAR = 1996


@query("dom_volatile_year", with_ctes(f"""
SELECT Country, Year, UnitPrice FROM (
  SELECT Country, Year, PrimaryValue / Qty AS UnitPrice FROM trade
  WHERE Year = (SELECT Year FROM trade WHERE Year >= {MIN_YEAR} AND Qty > 0 AND PrimaryValue > 0
                GROUP BY Year ORDER BY stddev_samp(PrimaryValue / Qty) DESC NULLS LAST, Year LIMIT 1)
    AND Qty > 0 AND PrimaryValue > 0 AND flowDesc = 'Import')
WHERE UnitPrice >= (SELECT min(UnitPrice) FROM (
  SELECT PrimaryValue / Qty AS UnitPrice FROM trade
  WHERE Year = (SELECT Year FROM trade WHERE Year >= {MIN_YEAR} AND Qty > 0 AND PrimaryValue > 0
                GROUP BY Year ORDER BY stddev_samp(PrimaryValue / Qty) DESC NULLS LAST, Year LIMIT 1)
    AND Qty > 0 AND PrimaryValue > 0 AND flowDesc = 'Import' ORDER BY UnitPrice DESC LIMIT 3))""", "trade"),
       doubles={"UnitPrice": 6})
def dom_volatile_year(spark, sf_dir):
    """Year with the most volatile unit price, then its top-3 import prices (ties kept)."""
    t = trade(spark, sf_dir).where((F.col("Qty") > 0) & (F.col("PrimaryValue") > 0))
    t = t.withColumn("UnitPrice", F.col("PrimaryValue") / F.col("Qty"))
    sd = t.where(F.col("Year") >= MIN_YEAR).groupBy("Year").agg(F.stddev_samp("UnitPrice").alias("sd"))
    year = sd.orderBy(F.col("sd").desc_nulls_last(), "Year").limit(1).select("Year").scalar()
    imports = t.where((F.col("Year") == year) & (F.col("flowDesc") == "Import")).select("Country", "Year", "UnitPrice")
    return rel.top_n_with_ties(imports, 3, "UnitPrice")


@query("dom_flow_unit_value", with_ctes("""
SELECT *, Import_UnitValue AS iu, Export_UnitValue / Import_UnitValue AS Ratio FROM (
  SELECT Country, Year, PrimaryValue_Import / Qty_Import AS Import_UnitValue,
         PrimaryValue_Export / Qty_Export AS Export_UnitValue FROM (
    SELECT Country, Year,
           max(CASE WHEN flowDesc = 'Import' THEN Qty END) AS Qty_Import,
           max(CASE WHEN flowDesc = 'Export' THEN Qty END) AS Qty_Export,
           max(CASE WHEN flowDesc = 'Import' THEN PrimaryValue END) AS PrimaryValue_Import,
           max(CASE WHEN flowDesc = 'Export' THEN PrimaryValue END) AS PrimaryValue_Export
    FROM trade GROUP BY 1, 2)
  WHERE Qty_Import > 0 AND Qty_Export > 0 AND PrimaryValue_Import > 0 AND PrimaryValue_Export > 0)""".replace(
    "Import_UnitValue AS iu, ", ""), "trade"), doubles={"Import_UnitValue": 6, "Export_UnitValue": 6, "Ratio": 9})
def dom_flow_unit_value(spark, sf_dir):
    """Import vs export unit value and their ratio per country and year."""
    w = pivot_multi(trade(spark, sf_dir), ["Country", "Year"], "flowDesc", ["Qty", "PrimaryValue"],
                    ["Import", "Export"], agg="first")
    w = w.where((F.col("Qty_Import") > 0) & (F.col("Qty_Export") > 0) & (F.col("PrimaryValue_Import") > 0)
                & (F.col("PrimaryValue_Export") > 0))
    iu = F.col("PrimaryValue_Import") / F.col("Qty_Import")
    eu = F.col("PrimaryValue_Export") / F.col("Qty_Export")
    return w.select("Country", "Year", iu.alias("Import_UnitValue"), eu.alias("Export_UnitValue"),
                    (eu / iu).alias("Ratio"))


@query("dom_trade_balance", with_ctes("""
SELECT Country, Year, NetValue, Status, LogDistance FROM (
  SELECT *, rank() OVER (PARTITION BY Year, Status ORDER BY LogDistance DESC) AS rk FROM (
    SELECT Country, Year, Import - Export AS NetValue,
           CASE WHEN Import - Export > 0 THEN 'Profit (Net Importer)' ELSE 'Pay to remove (Net Exporter)' END AS Status,
           abs(log10(Import) - log10(Export)) AS LogDistance FROM (
      SELECT Country, Year, max(CASE WHEN flowDesc = 'Import' THEN PrimaryValue END) AS Import,
             max(CASE WHEN flowDesc = 'Export' THEN PrimaryValue END) AS Export FROM trade GROUP BY 1, 2)
    WHERE Import > 0 AND Export > 0))
WHERE rk <= 5""", "trade"), doubles={"NetValue": 4, "LogDistance": 9})
def dom_trade_balance(spark, sf_dir):
    """Net value, status and log distance; the 5 most extreme per year and status."""
    w = pivot_single(trade(spark, sf_dir), ["Country", "Year"], "flowDesc", "PrimaryValue", ["Import", "Export"])
    w = w.where((F.col("Import") > 0) & (F.col("Export") > 0))
    net = F.col("Import") - F.col("Export")
    w = w.select("Country", "Year", net.alias("NetValue"),
                 F.when(net > 0, "Profit (Net Importer)").otherwise("Pay to remove (Net Exporter)").alias("Status"),
                 F.abs(F.log10("Import") - F.log10("Export")).alias("LogDistance"))
    return rel.top_n_with_ties(w, 5, "LogDistance", partition=["Year", "Status"])


@query("dom_unit_price_series", with_ctes("""
SELECT Country, flowDesc, Year, PrimaryValue / Qty AS UnitPrice FROM trade WHERE Qty > 0 AND PrimaryValue > 0""",
    "trade"), doubles={"UnitPrice": 6})
def dom_unit_price_series(spark, sf_dir):
    """Unit price per year for every country and flow."""
    t = trade(spark, sf_dir).where((F.col("Qty") > 0) & (F.col("PrimaryValue") > 0))
    return t.select("Country", "flowDesc", "Year", (F.col("PrimaryValue") / F.col("Qty")).alias("UnitPrice"))


@query("dom_scaled_series", with_ctes("""
SELECT Country, flowDesc, Year, Qty / 1e9 AS Qty_bn, PrimaryValue / 1e9 AS Value_bn FROM trade""", "trade"),
       doubles={"Qty_bn": 15, "Value_bn": 12})
def dom_scaled_series(spark, sf_dir):
    """Quantity and value in billions per country, flow and year."""
    t = trade(spark, sf_dir)
    return t.select("Country", "flowDesc", "Year", (F.col("Qty") / 1e9).alias("Qty_bn"),
                    (F.col("PrimaryValue") / 1e9).alias("Value_bn"))


@query("dom_positive_scatter", with_ctes("""
SELECT Country, Year, Qty, PrimaryValue FROM trade WHERE flowDesc = 'Import' AND Qty > 0 AND PrimaryValue > 0""",
    "trade"), doubles={"Qty": 6, "PrimaryValue": 4})
def dom_positive_scatter(spark, sf_dir):
    """Import rows with both measures positive (scatter input), every year."""
    t = trade(spark, sf_dir)
    return t.where((F.col("flowDesc") == "Import") & (F.col("Qty") > 0) & (F.col("PrimaryValue") > 0)).select(
        "Country", "Year", "Qty", "PrimaryValue")


@query("dom_volume_long", with_ctes("""
SELECT Country, Year, Source, Volume_Million_Tonnes,
       CASE WHEN Source = 'Processed_Own_Waste' THEN 'Domestic Waste'
            WHEN Source = 'Processed_Others_Waste' THEN 'Imported Waste' END AS Source_Label
FROM waste UNPIVOT INCLUDE NULLS (Volume_Million_Tonnes FOR Source IN (Processed_Own_Waste, Processed_Others_Waste))""",
    "waste"), doubles={"Volume_Million_Tonnes": 9})
def dom_volume_long(spark, sf_dir):
    """Own / others' processed volumes long with display labels."""
    w = unpivot_long(waste(spark, sf_dir).select("Country", "Year", "Processed_Own_Waste", "Processed_Others_Waste"),
                     ["Country", "Year"], ["Processed_Own_Waste", "Processed_Others_Waste"], "Source",
                     "Volume_Million_Tonnes")
    return w.withColumn("Source_Label", X.case_when(
        (F.col("Source") == "Processed_Own_Waste", F.lit("Domestic Waste")),
        (F.col("Source") == "Processed_Others_Waste", F.lit("Imported Waste"))))


# --- app feeds --------------------------------------------------------------------------------

register("app_trade", f"""
SELECT Year, CountryCode, Country, flowDesc, Qty AS Qty_raw, PrimaryValue AS PrimaryValue_raw,
       Qty_filled AS Qty_imputed, PrimaryValue_filled AS PrimaryValue_imputed FROM (
  SELECT *, CASE WHEN PrimaryValue IS NULL AND Qty_filled IS NOT NULL AND unit_price_final IS NOT NULL
                 THEN Qty_filled * unit_price_final ELSE PrimaryValue END AS PrimaryValue_filled FROM (
    SELECT *, {sf.if_else3('(Qty IS NULL OR (Qty = 0 AND PrimaryValue IS NOT NULL AND PrimaryValue > 0)) AND PrimaryValue IS NOT NULL AND unit_price_final IS NOT NULL AND unit_price_final > 0', 'PrimaryValue / unit_price_final', 'Qty')} AS Qty_filled
    FROM (SELECT *, coalesce(unit_price_interp, global_unit_price) AS unit_price_final FROM (
      SELECT *, {sf.chain('unit_price_raw', ['CountryCode', 'flowDesc'], 'Year')} AS unit_price_interp FROM imp_raw))))""",
         ("imp_raw",))
register("snapshot_raw", """
SELECT CountryCode, Country, Year,
       coalesce(sum(CASE WHEN flowDesc = 'Import' THEN tq END), 0.0) AS total_qty_Import,
       coalesce(sum(CASE WHEN flowDesc = 'Export' THEN tq END), 0.0) AS total_qty_Export,
       coalesce(sum(CASE WHEN flowDesc = 'Import' THEN tv END), 0.0) AS total_value_Import,
       coalesce(sum(CASE WHEN flowDesc = 'Export' THEN tv END), 0.0) AS total_value_Export
FROM (SELECT CountryCode, Country, Year, flowDesc, coalesce(sum(Qty_raw), 0.0) AS tq,
             coalesce(sum(PrimaryValue_raw), 0.0) AS tv FROM app_trade GROUP BY 1, 2, 3, 4)
GROUP BY 1, 2, 3""", ("app_trade",))
register("snapshot", """
SELECT CountryCode, Country, Year,
       coalesce(sum(CASE WHEN flowDesc = 'Import' THEN tq END), 0.0) AS total_qty_Import,
       coalesce(sum(CASE WHEN flowDesc = 'Export' THEN tq END), 0.0) AS total_qty_Export,
       coalesce(sum(CASE WHEN flowDesc = 'Import' THEN tv END), 0.0) AS total_value_Import,
       coalesce(sum(CASE WHEN flowDesc = 'Export' THEN tv END), 0.0) AS total_value_Export
FROM (SELECT CountryCode, Country, Year, flowDesc, coalesce(sum(Qty_imputed), 0.0) AS tq,
             coalesce(sum(PrimaryValue_imputed), 0.0) AS tv FROM app_trade GROUP BY 1, 2, 3, 4)
GROUP BY 1, 2, 3""", ("app_trade",))


def app_trade(spark, sf_dir, t_long=None):
    from ..operators import imputation as imp
    t_long = t_long if t_long is not None else trade(spark, sf_dir)
    df = imp.impute_trade(t_long, keys=("CountryCode", "flowDesc"))
    return df.select("Year", "CountryCode", "Country", "flowDesc", F.col("Qty").alias("Qty_raw"),
                     F.col("PrimaryValue").alias("PrimaryValue_raw"), F.col("Qty_filled").alias("Qty_imputed"),
                     F.col("PrimaryValue_filled").alias("PrimaryValue_imputed"))


def year_snapshot(spark, sf_dir, source: str = "imputed", app=None):
    """Per country × year × flow totals of the chosen source, pivoted, 0-filled."""
    q, v = ("Qty_raw", "PrimaryValue_raw") if source == "raw" else ("Qty_imputed", "PrimaryValue_imputed")
    app = app if app is not None else app_trade(spark, sf_dir)
    t = app.groupBy("CountryCode", "Country", "Year", "flowDesc").agg(
        X.sum0(q).alias("total_qty"), X.sum0(v).alias("total_value"))
    return pivot_multi(t, ["CountryCode", "Country", "Year"], "flowDesc", ["total_qty", "total_value"],
                       ["Import", "Export"], agg="sum", fill=0.0)


SNAP_D = {"total_qty_Import": 6, "total_qty_Export": 6, "total_value_Import": 4, "total_value_Export": 4}


@query("dom_year_snapshot", with_ctes("SELECT * FROM snapshot", "snapshot"), doubles=SNAP_D)
def dom_year_snapshot(spark, sf_dir):
    """Per-country trade totals for every year (imputed source)."""
    return year_snapshot(spark, sf_dir, "imputed")


@query("dom_year_snapshot_sources", with_ctes("""
SELECT *, 'raw' AS source FROM snapshot_raw UNION ALL SELECT *, 'imputed' AS source FROM snapshot""",
    "snapshot_raw", "snapshot"), doubles=SNAP_D)
def dom_year_snapshot_sources(spark, sf_dir):
    """Per-country trade totals for every year, from the raw and from the imputed data."""
    app = cut_lineage(app_trade(spark, sf_dir))     # read for both sources
    return year_snapshot(spark, sf_dir, "raw", app).withColumn("source", F.lit("raw")).unionByName(
        year_snapshot(spark, sf_dir, "imputed", app).withColumn("source", F.lit("imputed")))


register("dim", """
SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS CountryCode, n_name AS name,
       regexp_replace(lower(trim(n_name)), '[^a-z0-9]+', '', 'g') AS k FROM nation""", ())
register("waste_year", """
SELECT d.CountryCode, w.Year, w.Est_Waste_Produced * 1e9 AS waste_prod_kg, w.Est_Recycled_Amount * 1e9 AS waste_recyc_kg,
       w.Processed_Own_Waste * 1e9 AS own_proc_kg, w.Processed_Others_Waste * 1e9 AS others_proc_kg,
       w.Percent_Own_Processed AS percent_own_proc
FROM waste w JOIN dim d ON regexp_replace(lower(trim(w.Country)), '[^a-z0-9]+', '', 'g') = d.k""", ("waste", "dim"))
register("metric_table", """
SELECT d.CountryCode, d.name, y.Year, s.total_qty_Import, s.total_qty_Export, s.total_value_Import,
       s.total_value_Export, w.waste_prod_kg, w.waste_recyc_kg, w.own_proc_kg, w.others_proc_kg, w.percent_own_proc,
       s.total_qty_Import AS metric_value, 'Waste imported (kg)' AS metric_label
FROM dim d CROSS JOIN (SELECT DISTINCT Year FROM trade) y
LEFT JOIN snapshot s ON d.CountryCode = s.CountryCode AND y.Year = s.Year
LEFT JOIN waste_year w ON d.CountryCode = w.CountryCode AND y.Year = w.Year""", ("dim", "trade", "snapshot", "waste_year"))

MT_D = {**SNAP_D, "waste_prod_kg": 2, "waste_recyc_kg": 2, "own_proc_kg": 2, "others_proc_kg": 2,
        "percent_own_proc": 7, "metric_value": 6}
METRIC_COLUMNS = {"import": ("total_qty_Import", "Waste imported (kg)"),
                  "export": ("total_qty_Export", "Waste exported (kg)"),
                  "waste_prod": ("waste_prod_kg", "Waste produced (kg)"),
                  "waste_recyc": ("waste_recyc_kg", "Waste recycled (kg)")}


def country_dim(spark, sf_dir):
    nation = b.table(spark, sf_dir, "nation")
    return nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("CountryCode"),
                         F.col("n_name").alias("name"), rel.normalised_name("n_name").alias("_k"))


def metric_table(spark, sf_dir, metric: str = "import", t_long=None, w=None):
    """``t_long``, ``w``: the trade panel and the waste table, from a caller that holds both."""
    col_name, label = METRIC_COLUMNS[metric]
    dim = country_dim(spark, sf_dir)
    if t_long is None or w is None:
        t_long, totals = trade_and_totals(spark, sf_dir)
        w = waste(spark, sf_dir, t_long, totals)
    app = cut_lineage(app_trade(spark, sf_dir, t_long))  # read twice: year list and snapshot
    # every country with every year of the data: dimension × years, no list collected
    cells = dim.select("CountryCode", F.lit(None).cast("int").alias("Year")).unionByName(
        app.select(F.lit(None).cast("string").alias("CountryCode"), "Year").distinct())
    grid = complete_grid(cells, ["CountryCode", "Year"]).dropna().join(dim, "CountryCode")
    wy = w.join(dim.select("CountryCode", "_k"), rel.normalised_name(w["Country"]) == F.col("_k")).select(
        "CountryCode", "Year", (F.col("Est_Waste_Produced") * 1e9).alias("waste_prod_kg"),
        (F.col("Est_Recycled_Amount") * 1e9).alias("waste_recyc_kg"),
        (F.col("Processed_Own_Waste") * 1e9).alias("own_proc_kg"),
        (F.col("Processed_Others_Waste") * 1e9).alias("others_proc_kg"),
        F.col("Percent_Own_Processed").alias("percent_own_proc"))
    snap = year_snapshot(spark, sf_dir, app=app).drop("Country")
    out = grid.drop("_k").join(snap, ["CountryCode", "Year"], "left").join(wy, ["CountryCode", "Year"], "left")
    return out.withColumn("metric_value", F.col(col_name)).withColumn("metric_label", F.lit(label))


@query("dom_metric_table", with_ctes("SELECT * FROM metric_table", "metric_table"), doubles=MT_D)
def dom_metric_table(spark, sf_dir):
    """Country dimension × year with trade and waste metrics and the chosen map metric."""
    return metric_table(spark, sf_dir, "import")


# The map's metrics and their labels.
MAP_METRICS = {**METRIC_COLUMNS, "import_value": ("total_value_Import", "Import value (USD)"),
               "export_value": ("total_value_Export", "Export value (USD)"),
               "sufficiency": ("Self_Sufficiency", "Self-sufficiency (%)"),
               "industry": ("Local_Industry_Value", "Industry value (USD)")}
_PRESCRIPTIVE = ("sufficiency", "industry")


def _metric_rows(names, table, code="CountryCode"):
    return " UNION ALL ".join(f"SELECT {code} AS CountryCode, Year, '{m}' AS metric, '{MAP_METRICS[m][1]}' AS label, "
                              f"{MAP_METRICS[m][0]} AS value FROM {table}" for m in names)


register("metric_long", f"""
{_metric_rows([m for m in MAP_METRICS if m not in _PRESCRIPTIVE], "metric_table")}
UNION ALL SELECT * FROM ({_metric_rows(_PRESCRIPTIVE, "(SELECT d.CountryCode, o.Year, o.Self_Sufficiency, o.Local_Industry_Value FROM e_out o JOIN dim d ON regexp_replace(lower(trim(o.Country)), '[^a-z0-9]+', '', 'g') = d.k WHERE o.Type = 'History')")})""",
         ("metric_table", "e_out", "dim"))


@query("dom_metric_long", with_ctes("SELECT * FROM metric_long", "metric_long"), doubles={"value": "sig6"})
def dom_metric_long(spark, sf_dir):
    """The map's eight metrics with labels, one row per country, year and metric."""
    t_long, totals = trade_and_totals(spark, sf_dir)
    w = cut_lineage(waste(spark, sf_dir, t_long, totals))    # read by the table and the forecast system
    t = metric_table(spark, sf_dir, "import", t_long, w)
    dim = country_dim(spark, sf_dir).select("CountryCode", "_k")
    o = e1(spark, sf_dir, wide=w).output().where(F.col("Type") == "History")
    o = o.join(dim, rel.normalised_name(o["Country"]) == F.col("_k"))

    def rows(df, names):
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(MAP_METRICS[m][1]).alias("label"),
                                   F.col(MAP_METRICS[m][0]).alias("value")) for m in names])
        return df.select("CountryCode", "Year", F.explode(cells).alias("x")).select("CountryCode", "Year", "x.*")
    return rows(t, [m for m in MAP_METRICS if m not in _PRESCRIPTIVE]).unionByName(rows(o, _PRESCRIPTIVE))


BINS = 7


def pretty_bins(df, value: str, by, n: int = BINS):
    """Equal 'pretty' bins over the value's domain per group (left-closed,
    top value in the last bin): unit ∈ {1, 2, 5, 10}·10^k chosen like R's
    ``pretty`` (high-unit bias 1.5, 5-bias 2.75)."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    cell = (F.col("_hi") - F.col("_lo")) / n
    base = F.pow(F.lit(10.0), F.floor(F.log10(cell)))
    unit = (F.when(2 * base - cell < 1.5 * (cell - base),
                   F.when(5 * base - cell < 2.75 * (cell - 2 * base),
                          F.when(10 * base - cell < 1.5 * (cell - 5 * base), 10 * base).otherwise(5 * base))
                   .otherwise(2 * base)).otherwise(base))
    df = df.withColumn("_unit", unit)
    ns = F.floor(F.col("_lo") / F.col("_unit") + 1e-7)
    nu = F.ceil(F.col("_hi") / F.col("_unit") - 1e-7)
    df = df.withColumn("_ns", ns).withColumn("_nb", nu - ns)
    bin_ = F.least(F.floor((F.col(value) - F.col("_ns") * F.col("_unit")) / F.col("_unit")) + 1, F.col("_nb"))
    df = df.withColumn("bin", F.when(F.col(value).isNotNull() & (F.col("_unit") > 0), bin_.cast("int")))
    df = df.withColumn("bin_lo", (F.col("_ns") + F.col("bin") - 1) * F.col("_unit")).withColumn(
        "bin_hi", (F.col("_ns") + F.col("bin")) * F.col("_unit"))
    return df.drop("_lo", "_hi", "_unit", "_ns", "_nb")


@query("dom_metric_bins", with_ctes("""
SELECT CountryCode, Year, metric_value,
       CASE WHEN metric_value IS NOT NULL AND unit > 0
            THEN CAST(least(floor((metric_value - ns * unit) / unit) + 1, nu - ns) AS INTEGER) END AS bin,
       (ns + CASE WHEN metric_value IS NOT NULL AND unit > 0
                  THEN CAST(least(floor((metric_value - ns * unit) / unit) + 1, nu - ns) AS INTEGER) END - 1) * unit
         AS bin_lo,
       (ns + CASE WHEN metric_value IS NOT NULL AND unit > 0
                  THEN CAST(least(floor((metric_value - ns * unit) / unit) + 1, nu - ns) AS INTEGER) END) * unit
         AS bin_hi
FROM (SELECT *, floor(lo / unit + 1e-7) AS ns, ceil(hi / unit - 1e-7) AS nu FROM (
  SELECT *, CASE WHEN 2 * base - cell < 1.5 * (cell - base)
                 THEN CASE WHEN 5 * base - cell < 2.75 * (cell - 2 * base)
                           THEN CASE WHEN 10 * base - cell < 1.5 * (cell - 5 * base) THEN 10 * base ELSE 5 * base END
                           ELSE 2 * base END
                 ELSE base END AS unit FROM (
    SELECT *, pow(10.0, floor(log10(cell))) AS base FROM (
      SELECT *, (hi - lo) / 7 AS cell FROM (
        SELECT CountryCode, Year, metric_value, min(metric_value) OVER (PARTITION BY Year) AS lo,
               max(metric_value) OVER (PARTITION BY Year) AS hi FROM metric_table)))))""", "metric_table"),
       doubles={"metric_value": 6, "bin_lo": 6, "bin_hi": 6})
def dom_metric_bins(spark, sf_dir):
    """Seven 'pretty' colour bins of the map metric per year."""
    m = metric_table(spark, sf_dir, "import").select("CountryCode", "Year", "metric_value")
    return pretty_bins(m, "metric_value", ["Year"])


_PROFILE_TRADE = """
SELECT CountryCode, Year, coalesce(sum(Qty_{s}) FILTER (flowDesc = 'Import'), 0.0) AS qi, coalesce(sum(Qty_{s}) FILTER (flowDesc = 'Export'), 0.0) AS qe,
       coalesce(sum(PrimaryValue_{s}) FILTER (flowDesc = 'Import'), 0.0) AS vi, coalesce(sum(PrimaryValue_{s}) FILTER (flowDesc = 'Export'), 0.0) AS ve
FROM app_trade GROUP BY 1, 2"""
PROFILE_D = {**{c: "sig8" for c in ("waste_produced_kg", "recycled_kg", "own_processed_kg", "others_processed_kg", "percent_own")},
             "import_qty": 6, "export_qty": 6, "import_value": 4, "export_value": 4}


@query("dom_country_profile", with_ctes(f"""
SELECT * FROM (WITH y AS (SELECT DISTINCT Year FROM app_trade UNION SELECT Year FROM waste),
c AS (SELECT 'N' || n_nationkey AS CountryCode, n_name AS Country FROM nation),
span AS (SELECT Country, min(Year) AS first_year, max(Year) AS last_year, min(Year) FILTER (Processed_Others_Waste > 0) AS turning_year FROM waste GROUP BY 1),
t AS (SELECT 'raw' AS source, * FROM ({_PROFILE_TRADE.format(s="raw")}) UNION ALL SELECT 'imputed', * FROM ({_PROFILE_TRADE.format(s="imputed")}))
SELECT c.CountryCode, c.Country, y.Year, s.source,
  CASE WHEN span.Country IS NULL THEN 'no data in any year' WHEN w.Country IS NULL THEN 'no data for this year' ELSE 'ok' END AS waste_state,
  span.first_year, span.last_year, span.turning_year, w.Est_Waste_Produced * 1e9 AS waste_produced_kg, w.Est_Recycled_Amount * 1e9 AS recycled_kg,
  w.Processed_Own_Waste * 1e9 AS own_processed_kg, w.Processed_Others_Waste * 1e9 AS others_processed_kg, w.Percent_Own_Processed AS percent_own,
  CASE WHEN t.CountryCode IS NULL OR (qi = 0 AND qe = 0 AND vi = 0 AND ve = 0) THEN 'no data' ELSE 'ok' END AS trade_state,
  qi AS import_qty, qe AS export_qty, vi AS import_value, ve AS export_value
FROM c CROSS JOIN y CROSS JOIN (VALUES ('raw'), ('imputed')) s(source)
LEFT JOIN span ON span.Country = c.Country LEFT JOIN waste w ON w.Country = c.Country AND w.Year = y.Year
LEFT JOIN t ON t.CountryCode = c.CountryCode AND t.Year = y.Year AND t.source = s.source)""", "waste", "app_trade"), doubles=PROFILE_D)
def dom_country_profile(spark, sf_dir):
    """Per country, year and trade source: the waste block and the trade block
    with their no-data states, the years available and the turning year (first
    year of processing others' waste).  Countries without a row keep their
    place; the years are those of either table (a list bounded by the calendar)."""
    t_long, totals = trade_and_totals(spark, sf_dir)
    w = cut_lineage(waste(spark, sf_dir, t_long, totals))
    app = cut_lineage(app_trade(spark, sf_dir, t_long))
    years = w.select("Year").union(app.select("Year")).agg(F.collect_set("Year")).scalar()
    places = b.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("CountryCode"), F.col("n_name").alias("Country"))
    places = (places.withColumn("Year", F.explode(years))
              .withColumn("source", F.explode(F.array(F.lit("raw"), F.lit("imputed")))))
    span = w.groupBy("Country").agg(F.min("Year").alias("first_year"), F.max("Year").alias("last_year"),
                                    F.min(F.when(F.col("Processed_Others_Waste") > 0, F.col("Year"))).alias("turning_year"))
    kg = w.select("Country", "Year", *[(F.col(c) * 1e9).alias(o) for c, o in (
        ("Est_Waste_Produced", "waste_produced_kg"), ("Est_Recycled_Amount", "recycled_kg"), ("Processed_Own_Waste", "own_processed_kg"),
        ("Processed_Others_Waste", "others_processed_kg"))], F.col("Percent_Own_Processed").alias("percent_own"), F.lit(True).alias("_has_waste"))
    both = app.select("CountryCode", "Year", "flowDesc", F.explode(F.array(*[
        F.struct(F.lit(s).alias("source"), F.col(f"Qty_{s}").alias("q"), F.col(f"PrimaryValue_{s}").alias("v")) for s in ("raw", "imputed")])).alias("x"))
    totals = both.groupBy("CountryCode", "Year", F.col("x.source").alias("source")).agg(*[
        F.coalesce(F.sum(F.when(F.col("flowDesc") == flow, F.col(f"x.{c}"))), F.lit(0.0)).alias(o)
        for flow, c, o in (("Import", "q", "import_qty"), ("Export", "q", "export_qty"), ("Import", "v", "import_value"), ("Export", "v", "export_value"))])
    j = places.join(span, "Country", "left").join(kg, ["Country", "Year"], "left").join(totals, ["CountryCode", "Year", "source"], "left")
    nothing = F.col("import_qty").isNull() | ((F.col("import_qty") == 0) & (F.col("export_qty") == 0) & (F.col("import_value") == 0) & (F.col("export_value") == 0))
    return j.select(
        "CountryCode", "Country", "Year", "source",
        F.when(F.col("first_year").isNull(), "no data in any year").when(F.col("_has_waste").isNull(), "no data for this year").otherwise("ok").alias("waste_state"),
        "first_year", "last_year", "turning_year", "waste_produced_kg", "recycled_kg", "own_processed_kg", "others_processed_kg", "percent_own",
        F.when(nothing, "no data").otherwise("ok").alias("trade_state"), "import_qty", "export_qty", "import_value", "export_value")


@query("dom_prescriptive_profile", with_ctes("""
SELECT Country, Year, Type,
       CASE WHEN Percent_Own_Processed IS NULL AND Local_Industry_Value IS NULL THEN 'no data' ELSE 'ok' END AS state,
       CASE WHEN Percent_Own_Processed IS NULL THEN 'n/a'
            ELSE format('{:,.2f}', round_even(Percent_Own_Processed, 2) + 0.0) END AS sufficiency_txt,
       CASE WHEN Local_Industry_Value IS NULL THEN 'n/a'
            ELSE format('{:,}', CAST(round_even(round(Local_Industry_Value, 2), 0) AS BIGINT)) END AS value_txt
FROM e_out""", "e_out"))
def dom_prescriptive_profile(spark, sf_dir):
    """Per country-year sufficiency and industry value as display text, with an explicit no-data state."""
    o = e1(spark, sf_dir).output()
    p, v = F.col("Percent_Own_Processed"), F.col("Local_Industry_Value")
    return o.select("Country", "Year", "Type",
                    F.when(p.isNull() & v.isNull(), "no data").otherwise("ok").alias("state"),
                    F.coalesce(F.format_number(F.bround(p, 2) + F.lit(0.0), 2), F.lit("n/a")).alias("sufficiency_txt"),
                    X.big_mark(v, pre_round=2).alias("value_txt"))


@query("dom_waste_history", with_ctes("""
SELECT Country, Year, Series, Value FROM (
  SELECT coalesce(w.Country, t.Country) AS Country, coalesce(w.Year, t.Year) AS Year,
         w.Est_Waste_Produced * 1e9 AS "Waste produced", w.Processed_Own_Waste * 1e9 AS "Own waste processed",
         w.Processed_Others_Waste * 1e9 AS "Others' waste processed", t.Import AS "Imports (kg)",
         t.Export AS "Exports (kg)"
  FROM waste w FULL JOIN (
    SELECT Country, Year, coalesce(sum(CASE WHEN flowDesc = 'Import' THEN q END), 0.0) AS Import,
           coalesce(sum(CASE WHEN flowDesc = 'Export' THEN q END), 0.0) AS Export
    FROM (SELECT Country, Year, flowDesc, coalesce(sum(Qty_imputed), 0.0) AS q FROM app_trade GROUP BY 1, 2, 3)
    GROUP BY 1, 2) t ON w.Country = t.Country AND w.Year = t.Year)
UNPIVOT INCLUDE NULLS (Value FOR Series IN ("Waste produced", "Own waste processed", "Others' waste processed",
                                            "Imports (kg)", "Exports (kg)"))""", "waste", "app_trade"),
       doubles={"Value": "sig10"})
def dom_waste_history(spark, sf_dir):
    """Waste history ⟗ imputed trade per country and year, five series long."""
    t_long, totals = trade_and_totals(spark, sf_dir)
    w = waste(spark, sf_dir, t_long, totals).select("Country", "Year", (F.col("Est_Waste_Produced") * 1e9).alias("Waste produced"),
                                    (F.col("Processed_Own_Waste") * 1e9).alias("Own waste processed"),
                                    (F.col("Processed_Others_Waste") * 1e9).alias("Others' waste processed"))
    t = app_trade(spark, sf_dir, t_long).groupBy("Country", "Year", "flowDesc").agg(X.sum0("Qty_imputed").alias("q"))
    t = pivot_multi(t, ["Country", "Year"], "flowDesc", ["q"], ["Import", "Export"], agg="sum", fill=0.0).select(
        "Country", "Year", F.col("q_Import").alias("Imports (kg)"), F.col("q_Export").alias("Exports (kg)"))
    j = w.join(t, ["Country", "Year"], "full")
    series = ["Waste produced", "Own waste processed", "Others' waste processed", "Imports (kg)", "Exports (kg)"]
    return unpivot_long(j, ["Country", "Year"], series, "Series", "Value")


@query("dom_prescriptive_history", with_ctes("""
SELECT Country, Year, Series, Value FROM (
  SELECT Country, Year, Percent_Own_Processed AS "Sufficiency Index (%)",
         Local_Industry_Value AS "Industry Value (USD)" FROM e_out)
UNPIVOT INCLUDE NULLS (Value FOR Series IN ("Sufficiency Index (%)", "Industry Value (USD)"))""", "e_out"),
       doubles={"Value": "sig7"})
def dom_prescriptive_history(spark, sf_dir):
    """Sufficiency and industry value long per country and year."""
    o = e1(spark, sf_dir).output().select("Country", "Year",
                                            F.col("Percent_Own_Processed").alias("Sufficiency Index (%)"),
                                            F.col("Local_Industry_Value").alias("Industry Value (USD)"))
    return unpivot_long(o, ["Country", "Year"], ["Sufficiency Index (%)", "Industry Value (USD)"], "Series", "Value")
