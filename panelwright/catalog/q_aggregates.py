"""§2.4 aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import aggregate as agg
from ..operators.reshape import level_order
from ..plans import prescriptive as pr
from ..sources import bindings as b
from .common import trade, waste
from .registry import query
from .sqlbind import register, with_ctes


@query("agg_sum_group", with_ctes("""
SELECT Country, Year, flowCode, coalesce(sum(Qty), 0.0) AS Total_Qty, coalesce(sum(PrimaryValue), 0.0) AS Total_Value
FROM trade GROUP BY 1, 2, 3""", "trade"), doubles={"Total_Qty": 6, "Total_Value": 4})
def agg_sum_group(spark, sf_dir):
    """sum(na.rm = TRUE) per group: an all-NULL group gives 0."""
    return agg.sum_by(trade(spark, sf_dir), ["Country", "Year", "flowCode"],
                      {"Total_Qty": "Qty", "Total_Value": "PrimaryValue"})


@query("agg_median_group", with_ctes("""
SELECT Country, flowDesc, median(PrimaryValue / Qty) AS median_price
FROM trade WHERE Qty > 0 AND PrimaryValue > 0 GROUP BY 1, 2""", "trade"), doubles={"median_price": 6})
def agg_median_group(spark, sf_dir):
    """Exact median unit price per country and flow."""
    t = trade(spark, sf_dir).where((F.col("Qty") > 0) & (F.col("PrimaryValue") > 0))
    return agg.median_by(t, ["Country", "flowDesc"], F.col("PrimaryValue") / F.col("Qty"), "median_price")


@query("agg_sd_group", with_ctes("""
SELECT Year, stddev_samp(PrimaryValue / nullif(Qty, 0)) AS price_sd, count(*) AS n
FROM trade WHERE flowDesc = 'Import' GROUP BY Year""", "trade"), doubles={"price_sd": 6})
def agg_sd_group(spark, sf_dir):
    """Volatility: sample sd of the import unit price per year (one row → NULL)."""
    t = trade(spark, sf_dir).where(F.col("flowDesc") == "Import")
    return t.groupBy("Year").agg(F.stddev_samp(X.safe_div("PrimaryValue", "Qty")).alias("price_sd"),
                                 F.count(F.lit(1)).alias("n"))


@query("agg_year_total", with_ctes("""
SELECT Year, sum(Est_Waste_Produced) AS Total_Waste, sum(Processed_Own_Waste) AS Total_Own,
       sum(Imports) AS Total_Imports FROM waste GROUP BY Year""", "waste"),
       doubles={"Total_Waste": 9, "Total_Own": 9, "Total_Imports": 12})
def agg_year_total(spark, sf_dir):
    """Panel totals per year."""
    return waste(spark, sf_dir).groupBy("Year").agg(
        F.sum("Est_Waste_Produced").alias("Total_Waste"), F.sum("Processed_Own_Waste").alias("Total_Own"),
        F.sum("Imports").alias("Total_Imports"))


@query("agg_min_max_bounds", with_ctes("""
SELECT min(Year) AS min_year, max(Year) AS max_year, count(DISTINCT Country) AS n_countries FROM trade""", "trade"))
def agg_min_max_bounds(spark, sf_dir):
    """Global year bounds (slider limits)."""
    return trade(spark, sf_dir).agg(F.min("Year").alias("min_year"), F.max("Year").alias("max_year"),
                                    F.countDistinct("Country").alias("n_countries"))


@query("agg_count_sorted", with_ctes("""
SELECT Country, count(*) AS n FROM trade
WHERE (Qty IS NULL OR Qty = 0) AND PrimaryValue IS NOT NULL AND PrimaryValue > 0
GROUP BY Country""", "trade"))
def agg_count_sorted(spark, sf_dir):
    """Rows with a value but no quantity, counted per country, most first."""
    t = trade(spark, sf_dir)
    need = ((F.col("Qty").isNull() | (F.col("Qty") == 0)) & F.col("PrimaryValue").isNotNull()
            & (F.col("PrimaryValue") > 0))
    return t.where(need).groupBy("Country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "Country")


@query("agg_share_of_total", with_ctes("SELECT * FROM gdp_shares", "gdp_shares"), doubles={"GDP_Share": 9})
def agg_share_of_total(spark, sf_dir):
    """GDP share of each country within its region and year (window sum)."""
    return pr.gdp_shares(pr.gdp_clean(b.gdp(spark, sf_dir), b.country_bridge(spark, sf_dir)))


@query("agg_first_year_where", with_ctes("""
SELECT Country, min(CASE WHEN Processed_Others_Waste > 0 THEN Year END) AS turning_year,
       min(CASE WHEN Imports > Exports THEN Year END) AS first_net_import_year
FROM waste GROUP BY Country""", "waste"))
def agg_first_year_where(spark, sf_dir):
    """Earliest year a condition holds (NULL if never)."""
    w = waste(spark, sf_dir)
    return w.groupBy("Country").agg(
        F.min(F.when(F.col("Processed_Others_Waste") > 0, F.col("Year"))).alias("turning_year"),
        F.min(F.when(F.col("Imports") > F.col("Exports"), F.col("Year"))).alias("first_net_import_year"))


@query("agg_all_null_flag", with_ctes("""
SELECT Country, Year, bool_and(Qty IS NULL AND PrimaryValue IS NULL) AS all_missing, count(*) AS n
FROM trade GROUP BY Country, Year""", "trade"))
def agg_all_null_flag(spark, sf_dir):
    """Per country-year: are all trade measures missing?"""
    return trade(spark, sf_dir).groupBy("Country", "Year").agg(
        agg.all_null(["Qty", "PrimaryValue"]).alias("all_missing"), F.count(F.lit(1)).alias("n"))


# Fixed value: the least series length of the reference.  A series here is one
# country, flow and year of months, which at every scale has full and short ones.
MIN_SERIES = 10


@query("agg_group_size_filter", with_ctes(f"""
SELECT * EXCLUDE (n) FROM (
  SELECT *, (Year - 1) // 12 AS period, count(*) OVER (PARTITION BY Country, flowDesc, (Year - 1) // 12) AS n
  FROM trade_m WHERE Qty IS NOT NULL)
WHERE n >= {MIN_SERIES}""", "trade_m"), doubles={"Qty": 6, "PrimaryValue": 4})
def agg_group_size_filter(spark, sf_dir):
    """Keep series (country, flow, year of months) with at least MIN_SERIES observed quantities."""
    t = b.trade_panel(spark, sf_dir, monthly=True, materialized=False).where(F.col("Qty").isNotNull())
    t = t.withColumn("period", F.expr("(Year - 1) div 12"))
    return agg.keep_groups_min_size(t, ["Country", "flowDesc", "period"], MIN_SERIES)


@query("agg_nonnull_gate", with_ctes("""
SELECT Year, Country, flowDesc, n_obs, n_obs >= 2 AS can_interpolate FROM (
  SELECT *, count(CASE WHEN Qty > 0 AND PrimaryValue > 0 THEN 1 END) OVER (PARTITION BY Country, flowDesc) AS n_obs
  FROM trade)""", "trade"))
def agg_nonnull_gate(spark, sf_dir):
    """Use interpolation only where a series has ≥ 2 observed prices."""
    t = trade(spark, sf_dir).withColumn(
        "_p", F.when((F.col("Qty") > 0) & (F.col("PrimaryValue") > 0), F.lit(1)))
    t = agg.nonnull_count(t, ["Country", "flowDesc"], "_p", "n_obs")
    return t.select("Year", "Country", "flowDesc", "n_obs", (F.col("n_obs") >= 2).alias("can_interpolate"))


register("unit_prices", """
SELECT Country, Year, flowDesc, PrimaryValue / Qty AS price FROM trade WHERE Qty > 0 AND PrimaryValue > 0""",
         ("trade",))


@query("agg_box_stats", with_ctes("""
SELECT p.flowDesc, q.q1, q.median, q.q3, q.iqr,
       min(CASE WHEN p.price BETWEEN q.q1 - 1.5 * q.iqr AND q.q3 + 1.5 * q.iqr THEN p.price END) AS whisker_lo,
       max(CASE WHEN p.price BETWEEN q.q1 - 1.5 * q.iqr AND q.q3 + 1.5 * q.iqr THEN p.price END) AS whisker_hi,
       count(CASE WHEN NOT (p.price BETWEEN q.q1 - 1.5 * q.iqr AND q.q3 + 1.5 * q.iqr) THEN 1 END) AS n_outliers
FROM unit_prices p JOIN (
  SELECT flowDesc, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median,
         quantile_cont(price, 0.75) AS q3, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr
  FROM unit_prices GROUP BY flowDesc) q ON p.flowDesc = q.flowDesc
GROUP BY ALL""", "unit_prices"), doubles={"q1": 6, "median": 6, "q3": 6, "iqr": 6, "whisker_lo": 6,
                                          "whisker_hi": 6})
def agg_box_stats(spark, sf_dir):
    """Quartiles, IQR whiskers and outlier counts of unit prices per flow."""
    t = trade(spark, sf_dir).where((F.col("Qty") > 0) & (F.col("PrimaryValue") > 0))
    t = t.withColumn("price", F.col("PrimaryValue") / F.col("Qty"))
    return agg.box_stats(t, ["flowDesc"], "price")


BINS = 10


@query("agg_histogram", with_ctes(f"""
SELECT bin, count(*) AS count, min(lo) + (bin - 1) * min(w) AS bin_lo, min(lo) + bin * min(w) AS bin_hi FROM (
  SELECT CAST(least(greatest(coalesce(ceil((price - lo) / nullif(w, 0)), 1), 1), {BINS}) AS INTEGER) AS bin, lo, w
  FROM (SELECT price, (SELECT min(price) FROM unit_prices) AS lo,
               ((SELECT max(price) FROM unit_prices) - (SELECT min(price) FROM unit_prices)) / {float(BINS)} AS w
        FROM unit_prices))
GROUP BY bin""", "unit_prices"), doubles={"bin_lo": 6, "bin_hi": 6})
def agg_histogram(spark, sf_dir):
    """Equal-width histogram of unit prices, right-closed bins, min in bin 1."""
    t = trade(spark, sf_dir).where((F.col("Qty") > 0) & (F.col("PrimaryValue") > 0))
    return agg.histogram(t.withColumn("price", F.col("PrimaryValue") / F.col("Qty")), "price", BINS)


COMPONENTS = ["Processed_Own_Waste", "Processed_Others_Waste"]


@query("agg_stacked_share", with_ctes("""
SELECT Country, Year, Source, Volume,
       sum(Volume) OVER (PARTITION BY Country, Year ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS Stack_Top
FROM (SELECT Country, Year, 'Processed_Own_Waste' AS Source, Processed_Own_Waste AS Volume, 1 AS ord FROM waste
      UNION ALL
      SELECT Country, Year, 'Processed_Others_Waste', Processed_Others_Waste, 2 FROM waste)""", "waste"),
       doubles={"Volume": 9, "Stack_Top": 9})
def agg_stacked_share(spark, sf_dir):
    """Per-year cumulative stack of own and others' processed volumes."""
    w = waste(spark, sf_dir).unpivot(["Country", "Year"], COMPONENTS, "Source", "Volume")
    w = w.withColumn("ord", level_order("Source", COMPONENTS))
    return agg.running_sum(w, ["Country", "Year"], ["ord"], "Volume", "Stack_Top").drop("ord")
