"""The derived panel fixtures have the shape the operators need."""

from pyspark.sql import functions as F

from panelwright.sources import bindings as b


def test_trade_panel_shape_and_missingness(spark, small_dir):
    t = b.trade_panel(spark, small_dir)
    assert t.columns == ["Year", "CountryCode", "Country", "flowCode", "flowDesc", "Qty", "PrimaryValue"]
    assert {r.flowDesc for r in t.select("flowDesc").distinct().collect()} == {"Import", "Export"}
    assert t.groupBy("Country", "flowDesc", "Year").count().where("count > 1").count() == 0
    r = t.agg(F.count(F.when(F.col("Qty").isNull(), 1)).alias("q_null"),
              F.count(F.when(F.col("Qty") == 0, 1)).alias("q_zero"),
              F.count(F.when(F.col("PrimaryValue").isNull(), 1)).alias("v_null")).collect()[0]
    assert r.q_null > 0 and r.q_zero > 0 and r.v_null > 0


def test_monthly_panel_has_real_gaps(spark, small_dir):
    m = b.trade_panel(spark, small_dir, monthly=True)
    spans = m.groupBy("Country", "flowDesc").agg((F.max("Year") - F.min("Year") + 1).alias("span"),
                                                 F.count(F.lit(1)).alias("n"))
    assert spans.where("n < span").count() > 0


def test_bridge_has_missing_codes_and_aliases(spark, small_dir):
    br = b.country_bridge(spark, small_dir)
    assert br.where("WB_Code IS NULL").count() > 0
    assert br.groupBy("WB_Code").count().where("WB_Code IS NOT NULL AND count > 1").count() > 0
    fixes = b.name_fixes(spark, small_dir)
    assert fixes.groupBy("alias").count().where("count > 1").count() == 1


def test_recycling_codes(spark, small_dir):
    codes = {r.PLASTICS_CODES for r in b.recycling(spark, small_dir).select("PLASTICS_CODES").distinct().collect()}
    assert codes == {"TOTAL", "REC", "LAND"}


def test_prescriptive_options(spark, small_dir):
    """Decisions kept as parameters: de-duplicated codes avoid double counting
    in regional totals; the zero guard replaces a NULL percentage by 0."""
    from panelwright.plans import prescriptive as pr
    g, br = b.gdp(spark, small_dir), b.country_bridge(spark, small_dir)
    dup = pr.gdp_clean(g, br).count()
    dedup = pr.gdp_clean(g, br, dedupe_codes=True).count()
    assert dedup < dup
    shares = pr.gdp_shares(pr.gdp_clean(g, br, dedupe_codes=True))
    sums = shares.groupBy("OECD_Code", "Year").agg(F.sum("GDP_Share").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-9 for r in sums)
    est = spark.createDataFrame([("A", 2000, 0.0, 1.0, 0.5)],
                                "Country string, Year int, Est_Waste_Produced double, "
                                "Est_Recycled_Amount double, Regional_Recycling_Rate double")
    tw = spark.createDataFrame([("A", 2000, 0.0, 0.0, 0.0, 0.0)],
                               "Country string, Year int, Imports double, Exports double, "
                               "Import_Value double, Export_Value double")
    assert pr.waste_processing(est, tw).collect()[0].Percent_Own_Processed is None
    assert pr.waste_processing(est, tw, guard="zero").collect()[0].Percent_Own_Processed == 0.0
