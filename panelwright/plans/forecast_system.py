"""Forecast system (E1): wide panel → outlier blanking and imputation →
history in kg → 7 series per country → scenario paths → self-sufficiency and
industry-value branches → merged output.

Spark shape: the two branches share ``forecast_input`` (one Exchange on
(Country, Variable) for the fill chain); each branch adds one pivot on
(Country, Year) and the industry branch one window on Country.  Scenario
paths come from a deterministic generator (md5 of key, path, step and seed),
so a recomputed partition reproduces the same numbers.
Stages read by several later stages are checkpointed (``cut_lineage``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, if_else3, pmax, pmin, std_normal
from ..operators import imputation as imp
from ..operators import timeseries as ts
from ..operators.aggregate import median_by
from ..operators.reshape import complete_grid, pivot_multi, pivot_single, union_by_name
from ..session import cut_lineage
from .model_table import ModelTable

MT = 1e9
VARS = ["Est_Waste_Produced_Kg", "Est_Recycled_Amount_Kg", "Imports_Kg", "Exports_Kg", "Import_Value",
        "Export_Value", "Regional_Recycling_Rate"]
RATE = "Regional_Recycling_Rate"


def trade_long(wide: DataFrame) -> DataFrame:
    """Imports and exports columns back to long trade rows tagged by flow."""
    imp_ = wide.select("Country", "Year", F.col("Imports").alias("Qty"), F.col("Import_Value").alias("PrimaryValue"),
                       F.lit("Import").alias("flowDesc"))
    exp_ = wide.select("Country", "Year", F.col("Exports").alias("Qty"), F.col("Export_Value").alias("PrimaryValue"),
                       F.lit("Export").alias("flowDesc"))
    return imp_.unionByName(exp_)


def history_data(wide: DataFrame, max_price: float, min_qty: float) -> DataFrame:
    """Blank outliers, impute quantities, rebuild the wide panel, fill 0, add kg columns."""
    t = imp.blank_outliers(trade_long(wide), max_price=max_price, min_qty=min_qty, qty_scale=MT)
    ref = imp.reference_price(t.where(F.col("Qty").isNotNull()))
    t = imp.unit_price(t, ("Country", "flowDesc"), "Year", price_ref=ref)
    t = imp.impute_quantity(t, strict_na=True)
    w = pivot_multi(t, ["Country", "Year"], "flowDesc", ["Qty_filled", "PrimaryValue"], ["Import", "Export"],
                    agg="first")
    w = w.select("Country", "Year", F.col("Qty_filled_Import").alias("Imports"),
                 F.col("Qty_filled_Export").alias("Exports"), F.col("PrimaryValue_Import").alias("Import_Value"),
                 F.col("PrimaryValue_Export").alias("Export_Value"))
    base = wide.select("Country", "Year", "Est_Waste_Produced", "Est_Recycled_Amount", RATE)
    h = base.join(w, on=["Country", "Year"], how="left").fillna(
        0.0, subset=["Imports", "Exports", "Import_Value", "Export_Value", RATE])
    # measures are fixed to cents and hundredths of a kg here, so what follows
    # does not depend on the order in which the facts were summed
    h = h.withColumns({"Import_Value": F.round("Import_Value", 2), "Export_Value": F.round("Export_Value", 2),
                       RATE: F.round(RATE, 9)})
    return h.withColumns({"Est_Recycled_Amount_Kg": F.round(F.col("Est_Recycled_Amount") * MT, 2),
                          "Est_Waste_Produced_Kg": F.round(F.col("Est_Waste_Produced") * MT, 2),
                          "Exports_Kg": F.round(F.col("Exports") * MT, 2), "Imports_Kg": F.round(F.col("Imports") * MT, 2)})


def forecast_input(history: DataFrame) -> DataFrame:
    """7 variables long, gaps filled per (Country, Variable), interp → locf → nocb → 0."""
    long = history.select("Country", "Year", *VARS).unpivot(["Country", "Year"], VARS, "Variable", "Amount")
    return ts.fill_chain(long, ["Country", "Variable"], "Year", "Amount", final=0.0)


def _metrics(df: DataFrame, own_name: str = "Processed_Own_Waste") -> DataFrame:
    own = F.col("Est_Recycled_Amount_Kg") - F.col("Exports_Kg")
    pct = if_else3(F.col("Est_Waste_Produced_Kg") > 0, own / F.col("Est_Waste_Produced_Kg") * 100, F.lit(0.0))
    return df.withColumn(own_name, own).withColumn("_pct", pct)


def self_sufficiency(history: DataFrame, paths: DataFrame) -> DataFrame:
    """Branch A: History and Forecast self-sufficiency (%)."""
    fut = paths.select("Country", "Year", "Variable", pmax("sim", 0.0).alias("Amount"))
    fut = pivot_single(fut, ["Country", "Year"], "Variable", "Amount", VARS)
    fut = _metrics(fut).select("Country", "Year", F.lit("Forecast").alias("Type"),
                               F.col("_pct").alias("Self_Sufficiency"))
    hist = _metrics(history).select("Country", "Year", F.lit("History").alias("Type"),
                                    F.col("_pct").alias("Self_Sufficiency"))
    return hist.unionByName(fut)


def industry_inputs(history: DataFrame, finput: DataFrame, paths: DataFrame, noise_seed: int,
                    rate_max: float = 100.0) -> DataFrame:
    """Branch B: noisy forecasts → complete grid → rate clamp → wide → metrics, ∪ history."""
    keys = ["Country", "Variable"]
    sd = finput.groupBy(*keys).agg(F.stddev_samp("Amount").alias("hist_sd"))
    j = paths.join(sd, on=keys, how="left")
    hsd = F.when(F.col("hist_sd").isNull() | (F.col("hist_sd") == 0), F.lit(0.001)).otherwise(F.col("hist_sd"))
    z = std_normal(F.col("Country"), F.col("Variable"), F.col("path"), F.col("Year"), seed=noise_seed)
    j = j.withColumn("Amount", pmax(F.col("sim") + z * hsd * 0.10, 0.0)).select("Country", "Year", "Variable", "Amount")
    # the grid reads the noisy paths for its levels and its cells: write them once
    j = complete_grid(cut_lineage(j), ["Country", "Year", "Variable"], fill={"Amount": 0.0}, levels={"Variable": VARS})
    j = j.withColumn("Amount", F.when(F.col("Variable") == RATE, clamp("Amount", 0.0, rate_max))
                     .otherwise(F.col("Amount")))
    fut = pivot_single(j, ["Country", "Year"], "Variable", "Amount", VARS)
    fut = (_metrics(fut).withColumn("Processed_Others_Waste", F.col("Imports_Kg"))
           .withColumnRenamed("_pct", "Percent_Own_Processed").withColumn("Type", F.lit("Forecast")))
    hist = (_metrics(history.select("Country", "Year", *VARS)).withColumn("Processed_Others_Waste", F.col("Imports_Kg"))
            .withColumnRenamed("_pct", "Percent_Own_Processed").withColumn("Type", F.lit("History")))
    return union_by_name(hist, fut)


def global_prices(full: DataFrame, min_kg: float = 1000.0) -> DataFrame:
    """Median import price per year over rows with more than ``min_kg`` imported."""
    rows = full.where(F.col("Imports_Kg") > min_kg)
    return median_by(rows, ["Year"], F.col("Import_Value") / F.col("Imports_Kg"), "Global_Avg_Price")


def industry_value(full: DataFrame, min_kg: float = 1000.0, price_cap: float = 2.50,
                   prices: DataFrame | None = None) -> DataFrame:
    """Price chain per country (raw → positional interp → locf/nocb → global
    fallback → cap → 3-year trailing mean) × processed volume."""
    prices = prices if prices is not None else global_prices(full, min_kg)
    j = full.join(prices, on="Year", how="left")
    raw = F.when(F.col("Imports_Kg") > min_kg, F.col("Import_Value") / F.col("Imports_Kg"))
    j = j.withColumn("Raw_Price", if_else3(F.col("Imports_Kg") > min_kg, raw, F.lit(None).cast("double")))
    # a country's year may occur as history and as forecast (series of unequal length): history first
    j = j.withColumn("_t", F.col("Year") * 2 + (F.col("Type") != "History").cast("int"))
    j = j.withColumn("_pos", F.row_number().over(ts._spec(["Country"], "_t")))
    j = j.withColumn("Interp_Price", ts.fill_chain_expr("Raw_Price", ["Country"], "_t", x="_pos")).drop("_pos")
    j = j.withColumn("Final_Price", pmin(F.coalesce("Interp_Price", "Global_Avg_Price"), price_cap))
    j = ts.roll_mean_right(j, ["Country"], "_t", "Final_Price", "Smoothed_Price").drop("_t")
    return j.withColumn("Local_Industry_Value",
                        (F.col("Processed_Own_Waste") + F.col("Processed_Others_Waste")) * F.col("Smoothed_Price"))


OUTPUT_COLS = ["Country", "Year", "Type", "Est_Waste_Produced_Kg", "Est_Recycled_Amount_Kg", RATE, "Imports_Kg",
               "Exports_Kg", "Import_Value", "Export_Value", "Processed_Own_Waste", "Processed_Others_Waste",
               "Percent_Own_Processed", "Self_Sufficiency", "Local_Industry_Value"]


def best_of_both(industry: DataFrame, self_df: DataFrame) -> DataFrame:
    return industry.join(self_df, on=["Country", "Year", "Type"], how="left").select(*OUTPUT_COLS)


class ForecastSystem:
    """The E1 job as stages that are planned when asked for.

    A stage read by several later ones is written to the shared checkpoint
    folder on its first such use (``_stored``), so plans stay linear; asking
    for the history alone plans nothing else.  The model is fitted once
    (``ModelTable``); the branches draw their paths from the stored fit.
    """

    def __init__(self, wide: DataFrame, h: int = 20, model: str = "NAIVE", max_price: float = 5.0,
                 min_qty: float = 1000.0, min_kg: float = 1000.0, price_cap: float = 2.50, seeds=(123, 124, 7)):
        self.wide, self.h, self.model, self.seeds = wide, h, model, seeds
        self.max_price, self.min_qty, self.min_kg, self.price_cap = max_price, min_qty, min_kg, price_cap
        self._written: dict[str, DataFrame] = {}
        self._models: ModelTable | None = None

    def _stored(self, stage: str) -> DataFrame:
        if stage not in self._written:
            self._written[stage] = cut_lineage(getattr(self, stage)())
        return self._written[stage]

    def _wide(self) -> DataFrame:
        return self.wide

    def history(self) -> DataFrame:
        # the panel is read for the trade rows and for the base columns
        return history_data(self._stored("_wide"), self.max_price, self.min_qty)

    def forecast_input(self) -> DataFrame:
        return forecast_input(self.history() if "history" not in self._written else self._stored("history"))

    def _paths(self, seed: int) -> DataFrame:
        if self._models is None:
            self._models = ModelTable(self._stored("forecast_input"), ["Country", "Variable"], "Year", "Amount")
        return self._models.paths(self.model, self.h, 1, seed)

    def self_sufficiency(self) -> DataFrame:
        return self_sufficiency(self._stored("history"), self._paths(self.seeds[0]))

    def full(self) -> DataFrame:
        hist = self._stored("history")
        return industry_inputs(hist, self._stored("forecast_input"), self._paths(self.seeds[1]), self.seeds[2])

    def global_prices(self) -> DataFrame:
        return global_prices(self._stored("full"), self.min_kg)

    def industry(self) -> DataFrame:
        return industry_value(self._stored("full"), self.min_kg, self.price_cap, self.global_prices())

    def output(self) -> DataFrame:
        return best_of_both(self.industry(), self.self_sufficiency())
