"""§2.5 window, ranking, sort and limit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import relational as rel
from ..operators import timeseries as ts
from .common import trade, trade_once
from .registry import query
from .sqlbind import register, with_ctes

TRADE_D = {"Qty": 6, "PrimaryValue": 4}

register("import_prices", """
SELECT Country, Year, PrimaryValue / nullif(Qty, 0) AS price FROM trade WHERE flowDesc = 'Import'""", ("trade",))


@query("sort_multi", with_ctes("SELECT * FROM trade", "trade"), doubles=TRADE_D)
def sort_multi(spark, sf_dir):
    """Order by country, then year descending, then flow."""
    return trade_once(spark, sf_dir).orderBy("Country", F.col("Year").desc(), "flowDesc")


@query("topn_no_ties", with_ctes("""
SELECT Country, sum(PrimaryValue) AS total_value FROM trade WHERE flowDesc = 'Import'
GROUP BY Country ORDER BY total_value DESC, Country LIMIT 5""", "trade"), doubles={"total_value": 4})
def topn_no_ties(spark, sf_dir):
    """First 5 rows after sorting (TakeOrderedAndProject)."""
    t = trade_once(spark, sf_dir).where(F.col("flowDesc") == "Import")
    totals = t.groupBy("Country").agg(F.sum("PrimaryValue").alias("total_value"))
    return rel.top_n(totals, 5, [F.col("total_value").desc(), F.col("Country")])


@query("topn_with_ties", with_ctes("""
SELECT Country, Year, price FROM (
  SELECT *, rank() OVER (ORDER BY price DESC) AS rk FROM import_prices WHERE price IS NOT NULL) WHERE rk <= 3""",
    "import_prices"), doubles={"price": 6})
def topn_with_ties(spark, sf_dir):
    """slice_max(price, n = 3): ties at the cut are kept."""
    p = trade(spark, sf_dir).where(F.col("flowDesc") == "Import").select(
        "Country", "Year", X.safe_div("PrimaryValue", "Qty").alias("price"))
    return rel.top_n_with_ties(p, 3, "price")


@query("topn_per_group", with_ctes("""
SELECT Year, Country, price FROM (
  SELECT *, rank() OVER (PARTITION BY Year ORDER BY price DESC) AS rk FROM import_prices WHERE price IS NOT NULL)
WHERE rk <= 2""", "import_prices"), doubles={"price": 6})
def topn_per_group(spark, sf_dir):
    """Top 2 import prices per year, ties kept."""
    p = trade_once(spark, sf_dir).where(F.col("flowDesc") == "Import").select(
        "Year", "Country", X.safe_div("PrimaryValue", "Qty").alias("price")).where(F.col("price").isNotNull())
    return rel.top_n_with_ties(p, 2, "price", partition=["Year"])


@query("nth_row", with_ctes("""
SELECT Country, Year, price FROM (
  SELECT *, row_number() OVER (ORDER BY price DESC, Country, Year) AS rn FROM import_prices WHERE price IS NOT NULL)
WHERE rn = 2""", "import_prices"), doubles={"price": 6})
def nth_row(spark, sf_dir):
    """The 2nd highest import price (row_number = 2 with a full tie-break),
    taken from a bounded top-2 rather than a global window."""
    p = trade(spark, sf_dir).where(F.col("flowDesc") == "Import").select(
        "Country", "Year", X.safe_div("PrimaryValue", "Qty").alias("price")).where(F.col("price").isNotNull())
    head = rel.top_n(p, 2, [F.col("price").desc(), F.col("Country"), F.col("Year")])
    w = Window.orderBy(F.col("price").desc(), F.col("Country"), F.col("Year"))
    return head.withColumn("_rn", F.row_number().over(w)).where("_rn = 2").drop("_rn")


@query("last_point", with_ctes("""
SELECT Country, flowDesc, max(Year) AS last_year, arg_max_null(Qty, Year) AS last_qty,
       arg_max_null(PrimaryValue, Year) AS last_value
FROM trade GROUP BY Country, flowDesc""", "trade"), doubles={"last_qty": 6, "last_value": 4})
def last_point(spark, sf_dir):
    """Row at the maximum index of each series (max_by, no sort)."""
    return trade_once(spark, sf_dir).groupBy("Country", "flowDesc").agg(
        F.max("Year").alias("last_year"), F.max_by("Qty", "Year").alias("last_qty"),
        F.max_by("PrimaryValue", "Year").alias("last_value"))


TARGET_YEAR = 1998


@query("nearest_index", with_ctes(f"""
SELECT Country, flowDesc, arg_min(Year, abs(Year - {TARGET_YEAR}) * 10000 + Year) AS nearest_year
FROM trade WHERE Qty IS NOT NULL GROUP BY Country, flowDesc""", "trade"))
def nearest_index(spark, sf_dir):
    """Observed year nearest to a requested year per series; the earlier year on a tie."""
    t = trade(spark, sf_dir).where(F.col("Qty").isNotNull())
    key = F.struct(F.abs(F.col("Year") - TARGET_YEAR), F.col("Year"))
    return t.groupBy("Country", "flowDesc").agg(F.min_by("Year", key).alias("nearest_year"))


@query("roll_mean_right", with_ctes("""
SELECT Country, Year, price,
       CASE WHEN rn >= 3 THEN full3
            ELSE first_value(CASE WHEN rn = 3 THEN full3 END IGNORE NULLS) OVER (PARTITION BY Country ORDER BY Year
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS price_smooth
FROM (SELECT *, row_number() OVER w AS rn,
             CASE WHEN count(price) OVER w3 = 3 THEN avg(price) OVER w3 END AS full3
      FROM import_prices
      WINDOW w AS (PARTITION BY Country ORDER BY Year),
             w3 AS (PARTITION BY Country ORDER BY Year ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
    "import_prices"), doubles={"price": 6, "price_smooth": 6})
def roll_mean_right(spark, sf_dir):
    """Width-3 right-aligned mean, first two rows extended from the first full window."""
    p = trade_once(spark, sf_dir).where(F.col("flowDesc") == "Import").select(
        "Country", "Year", X.safe_div("PrimaryValue", "Qty").alias("price"))
    return ts.roll_mean_right(p, ["Country"], "Year", "price", "price_smooth")


@query("series_index_declare", with_ctes("""
SELECT Country, Year, count(*) AS n_rows FROM trade GROUP BY Country, Year HAVING count(*) > 1""", "trade"))
def series_index_declare(spark, sf_dir):
    """Duplicate (key, index) rows: keyed by Country only, each year holds two flows."""
    return ts.duplicate_index_rows(trade_once(spark, sf_dir), ["Country"], "Year")
