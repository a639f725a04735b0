"""§2.1 sources/sinks, §2.2 projections/filters/predicates, §2.8 scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import relational as rel
from ..operators.timeseries import fill_chain_expr
from ..sources import bindings as b
from ..sources import files
from . import sqlfrag as sf
from .common import WASTE_DIGITS, scratch_path, trade, trade_once, waste
from .registry import query
from .sqlbind import with_ctes

TRADE_COLS = ["Year", "CountryCode", "Country", "flowCode", "flowDesc", "Qty", "PrimaryValue"]
TRADE_D = {"Qty": 6, "PrimaryValue": 4}
WASTE_COLS = list(WASTE_DIGITS)

# --- 2.1 sources and sinks -------------------------------------------------------


@query("src_csv_panel", with_ctes("SELECT * FROM trade", "trade"), doubles=TRADE_D)
def src_csv_panel(spark, sf_dir):
    """Panel written as header CSV with NA for NULL, read back with an explicit schema."""
    path = scratch_path(spark, "trade_csv")
    files.write_csv(trade_once(spark, sf_dir), path)
    return files.read_csv_panel(spark, path, "trade")


@query("src_csv_dim", with_ctes("SELECT * FROM country_bridge", "country_bridge"))
def src_csv_dim(spark, sf_dir):
    """Dimension CSV (NA = missing code) round trip."""
    path = scratch_path(spark, "bridge_csv")
    files.write_csv(b.country_bridge(spark, sf_dir), path)
    return files.read_csv_panel(spark, path, "country_bridge")


@query("src_indicator", with_ctes("""
SELECT WB_Code, Country, Year, GDP FROM gdp WHERE Year BETWEEN 1996 AND 2000""", "gdp"),
       doubles={"GDP": 4})
def src_indicator(spark, sf_dir):
    """Indicator pull from a landed table partitioned by indicator: partition
    pruning on the code, pushed-down year range, select + rename."""
    g = b.gdp(spark, sf_dir)
    landed = g.select(F.col("WB_Code").alias("iso3c"), F.col("Country").alias("country"),
                      F.col("Year").alias("date"), F.lit("NY.GDP.MKTP.KD").alias("indicator"),
                      F.col("GDP").alias("value"))
    path = scratch_path(spark, "indicators")
    files.write_parquet(landed, path, partition_by=["indicator"])
    r = files.read_parquet(spark, path)
    return (r.where((F.col("indicator") == "NY.GDP.MKTP.KD") & F.col("date").between(1996, 2000))
             .select(F.col("iso3c").alias("WB_Code"), F.col("country").alias("Country"),
                     F.col("date").alias("Year"), F.col("value").alias("GDP")))


@query("src_country_dim", with_ctes("""
SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS CountryCode, n_name AS name FROM nation"""))
def src_country_dim(spark, sf_dir):
    """Country code → name dimension stored as Parquet and read back."""
    n = b.table(spark, sf_dir, "nation")
    dim = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("CountryCode"),
                   F.col("n_name").alias("name"))
    path = scratch_path(spark, "country_dim")
    files.write_parquet(dim, path)
    return files.read_parquet(spark, path)


@query("sink_csv", with_ctes("SELECT * FROM waste", "waste"), doubles=WASTE_DIGITS)
def sink_csv(spark, sf_dir):
    """Result table written as CSV without row names (NA for NULL) and read back."""
    path = scratch_path(spark, "waste_csv")
    files.write_csv(waste(spark, sf_dir), path)
    return files.read_csv_panel(spark, path, "waste")


# --- 2.2 projections, filters, predicates ----------------------------------------


@query("proj_select_rename", with_ctes("""
SELECT Country, Year, Qty AS Quantity, PrimaryValue AS TradeValue, flowDesc FROM trade""", "trade"),
       doubles={"Quantity": 6, "TradeValue": 4})
def proj_select_rename(spark, sf_dir):
    """select, rename, select-with-rename and drop."""
    t = trade_once(spark, sf_dir)
    return (t.select("Country", "Year", F.col("Qty").alias("Quantity"), "PrimaryValue", "flowDesc", "flowCode")
             .withColumnRenamed("PrimaryValue", "TradeValue").drop("flowCode"))


@query("proj_transmute", with_ctes("""
SELECT Country, Year, Est_Waste_Produced * 1e3 AS Waste_kt, Imports * 1e9 AS Imports_kg,
       Exports * 1e9 AS Exports_kg, Percent_Own_Processed AS Pct_Own FROM waste""", "waste"),
       doubles={"Waste_kt": 6, "Imports_kg": 4, "Exports_kg": 4, "Pct_Own": 7})
def proj_transmute(spark, sf_dir):
    """Keep only computed columns."""
    w = waste(spark, sf_dir)
    return w.select("Country", "Year", (F.col("Est_Waste_Produced") * 1e3).alias("Waste_kt"),
                    (F.col("Imports") * 1e9).alias("Imports_kg"), (F.col("Exports") * 1e9).alias("Exports_kg"),
                    F.col("Percent_Own_Processed").alias("Pct_Own"))


METRICS = ("Imports", "Exports", "Import_Value", "Export_Value", "Percent_Own_Processed")


def dynamic_metric(df, metric: str):
    """Column chosen at run time, validated against a whitelist."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    return df.select("Country", "Year", F.lit(metric).alias("metric"), F.col(metric).alias("value"))


@query("proj_dynamic_column", with_ctes("""
SELECT Country, Year, 'Export_Value' AS metric, Export_Value AS value FROM waste""", "waste"),
       doubles={"value": 4})
def proj_dynamic_column(spark, sf_dir):
    return dynamic_metric(waste(spark, sf_dir), "Export_Value")


@query("proj_unit_scale", with_ctes("""
SELECT Country, Year, flowDesc, Qty / 1e9 AS Qty_Mt, (Qty / 1e9) * 1e9 AS Qty_kg FROM trade""", "trade"),
       doubles={"Qty_Mt": 15, "Qty_kg": 6})
def proj_unit_scale(spark, sf_dir):
    """kg → million tonnes and back (factor 1e9)."""
    t = trade_once(spark, sf_dir)
    mt = F.col("Qty") / 1e9
    return t.select("Country", "Year", "flowDesc", mt.alias("Qty_Mt"), (mt * 1e9).alias("Qty_kg"))


NUM_FILL = ["Imports", "Exports", "Import_Value", "Export_Value", "Percent_Own_Processed"]


@query("proj_across_numeric", with_ctes(
    "SELECT Country, Year, " + ", ".join(f"{sf.chain(c, ['Country'], 'Year')} AS {c}" for c in NUM_FILL)
    + " FROM waste", "waste"), doubles={c: WASTE_DIGITS[c] for c in NUM_FILL})
def proj_across_numeric(spark, sf_dir):
    """One expression (interp → locf → nocb) applied to every numeric column."""
    w = waste(spark, sf_dir).select("Country", "Year", *NUM_FILL)
    numeric = [f.name for f in w.schema.fields if f.dataType.typeName() == "double"]
    return w.withColumns({c: fill_chain_expr(c, ["Country"], "Year") for c in numeric})


@query("proj_tag_literal", with_ctes("""
SELECT Country, Year, Imports AS Qty, Import_Value AS PrimaryValue, 'Import' AS flowDesc FROM waste
UNION ALL
SELECT Country, Year, Exports, Export_Value, 'Export' FROM waste""", "waste"),
       doubles={"Qty": 12, "PrimaryValue": 4})
def proj_tag_literal(spark, sf_dir):
    """Long trade rebuilt from wide columns, each half tagged with a literal flow."""
    w = waste(spark, sf_dir)
    imp = w.select("Country", "Year", F.col("Imports").alias("Qty"), F.col("Import_Value").alias("PrimaryValue"),
                   F.lit("Import").alias("flowDesc"))
    exp = w.select("Country", "Year", F.col("Exports").alias("Qty"), F.col("Export_Value").alias("PrimaryValue"),
                   F.lit("Export").alias("flowDesc"))
    return imp.unionByName(exp)


@query("proj_cast_int", with_ctes("""
SELECT Country, Year, CAST(CAST(Year AS VARCHAR) AS INTEGER) AS Year_int,
       CAST(trunc(Percent_Own_Processed) AS INTEGER) AS Pct_int FROM waste""", "waste"))
def proj_cast_int(spark, sf_dir):
    """``as.integer``: text year → INT, double → INT truncating toward zero."""
    w = waste(spark, sf_dir)
    return w.select("Country", "Year", F.col("Year").cast("string").cast("int").alias("Year_int"),
                    F.col("Percent_Own_Processed").cast("int").alias("Pct_int"))


@query("cond_if_else", with_ctes(f"""
SELECT Year, Country, flowDesc,
       {sf.if_else3('Qty > 0 AND PrimaryValue > 0', 'PrimaryValue / Qty', 'NULL')} AS unit_price_raw,
       {sf.if_else3('Qty > PrimaryValue / 2000', "'heavy'", "'light'")} AS weight_class
FROM trade""", "trade"), doubles={"unit_price_raw": 6})
def cond_if_else(spark, sf_dir):
    """Tri-valued if/else: a NULL condition gives NULL, not the else branch."""
    t = trade_once(spark, sf_dir)
    q, v = F.col("Qty"), F.col("PrimaryValue")
    return t.select("Year", "Country", "flowDesc",
                    X.if_else3((q > 0) & (v > 0), v / q, F.lit(None).cast("double")).alias("unit_price_raw"),
                    X.if_else3(q > v / 2000, F.lit("heavy"), F.lit("light")).alias("weight_class"))


@query("cond_case_when", with_ctes("""
SELECT Country, Year, CASE WHEN Percent_Own_Processed IS NULL THEN 'unknown'
                           WHEN Percent_Own_Processed >= 50 THEN 'mostly own'
                           WHEN Percent_Own_Processed >= 0 THEN 'partly own'
                           ELSE 'net exporter' END AS status FROM waste""", "waste"))
def cond_case_when(spark, sf_dir):
    """Ordered cases with a default."""
    p = F.col("Percent_Own_Processed")
    return waste(spark, sf_dir).select("Country", "Year", X.case_when(
        (p.isNull(), F.lit("unknown")), (p >= 50, F.lit("mostly own")), (p >= 0, F.lit("partly own")),
        default=F.lit("net exporter")).alias("status"))


@query("null_fill", with_ctes("""
SELECT Year, Country, flowDesc, coalesce(Qty, 0.0) AS Qty, coalesce(PrimaryValue, 0.0) AS PrimaryValue,
       coalesce(Qty, PrimaryValue / 2000.0, 0.0) AS Qty_guess FROM trade""", "trade"),
       doubles={"Qty": 6, "PrimaryValue": 4, "Qty_guess": 6})
def null_fill(spark, sf_dir):
    """replace_na / coalesce."""
    t = trade_once(spark, sf_dir).select("Year", "Country", "flowDesc", "Qty", "PrimaryValue")
    return (t.withColumn("Qty_guess", F.coalesce("Qty", F.col("PrimaryValue") / 2000.0, F.lit(0.0)))
             .fillna(0.0, subset=["Qty", "PrimaryValue"]))


@query("clamp", with_ctes("""
SELECT Country, Year,
       CASE WHEN Processed_Own_Waste IS NOT NULL THEN greatest(Processed_Own_Waste, 0.0) END AS Own_pos,
       CASE WHEN Percent_Own_Processed IS NOT NULL THEN least(greatest(Percent_Own_Processed, 0.0), 100.0) END
           AS Pct_clamped,
       CASE WHEN Import_Value / nullif(Imports * 1e9, 0) IS NOT NULL
            THEN least(Import_Value / nullif(Imports * 1e9, 0), 2000.0) END AS Price_capped
FROM waste""", "waste"), doubles={"Own_pos": 9, "Pct_clamped": 7, "Price_capped": 6})
def clamp(spark, sf_dir):
    """Lower clamp at 0, rate clamp [0, 100], price cap; NULL stays NULL."""
    w = waste(spark, sf_dir)
    price = X.safe_div(F.col("Import_Value"), F.col("Imports") * 1e9)
    return w.select("Country", "Year", X.pmax("Processed_Own_Waste", 0.0).alias("Own_pos"),
                    X.clamp("Percent_Own_Processed", 0.0, 100.0).alias("Pct_clamped"),
                    X.pmin(price, 2000.0).alias("Price_capped"))


@query("filter_compare", with_ctes("""
SELECT * FROM trade WHERE Year >= 1996 AND Year <= 2000 AND Qty > 1000 AND flowDesc = 'Import'""", "trade"),
       doubles=TRADE_D)
def filter_compare(spark, sf_dir):
    """Comparisons on year, quantity and flow; the years reach the scan of orders."""
    t = trade_once(spark, sf_dir, years=(1996, 2000))
    return t.where(F.col("Year").between(1996, 2000) & (F.col("Qty") > 1000) & (F.col("flowDesc") == "Import"))


@query("filter_in_list", with_ctes("""
SELECT * FROM recycling WHERE PLASTICS_CODES IN ('REC', 'TOTAL')""", "recycling"), doubles={"OBS_VALUE": 6})
def filter_in_list(spark, sf_dir):
    return b.recycling(spark, sf_dir).where(F.col("PLASTICS_CODES").isin("REC", "TOTAL"))


@query("filter_is_finite", with_ctes("""
SELECT Year, Country, flowDesc, ratio FROM (
  SELECT Year, Country, flowDesc, PrimaryValue / nullif(Qty, 0) AS ratio FROM trade)
WHERE ratio IS NOT NULL AND NOT isnan(ratio) AND abs(ratio) < 'inf'::DOUBLE""", "trade"),
       doubles={"ratio": 6})
def filter_is_finite(spark, sf_dir):
    """Drop Inf/NaN/NULL ratios."""
    t = trade_once(spark, sf_dir).select("Year", "Country", "flowDesc",
                                    X.safe_div("PrimaryValue", "Qty").alias("ratio"))
    return t.where(X.is_finite("ratio"))


@query("filter_key_equals", with_ctes("""
SELECT t.* FROM trade t WHERE t.Country = (
  SELECT Country FROM trade
  WHERE (Qty IS NULL OR Qty = 0) AND PrimaryValue IS NOT NULL AND PrimaryValue > 0
  GROUP BY Country ORDER BY count(*) DESC, Country LIMIT 1)""", "trade"), doubles=TRADE_D)
def filter_key_equals(spark, sf_dir):
    """One-country slice; the country is the one with most quantities to
    impute (ties by name), found as a scalar subquery."""
    t = trade(spark, sf_dir)
    need = ((F.col("Qty").isNull() | (F.col("Qty") == 0)) & F.col("PrimaryValue").isNotNull()
            & (F.col("PrimaryValue") > 0))
    target = (t.where(need).groupBy("Country").count()
               .orderBy(F.col("count").desc(), F.col("Country")).limit(1).select("Country").scalar())
    return t.where(F.col("Country") == target)


@query("distinct_keep_first", with_ctes("""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY Country ORDER BY Year, flowDesc) AS rn FROM trade) WHERE rn = 1""",
    "trade"), doubles=TRADE_D)
def distinct_keep_first(spark, sf_dir):
    """distinct(Country, .keep_all = TRUE): the first row per country in (Year, flow) order."""
    return rel.distinct_keep_first(trade_once(spark, sf_dir), ["Country"], ["Year", "flowDesc"])


@query("distinct_sorted", with_ctes("""
SELECT DISTINCT Year FROM trade""", "trade"))
def distinct_sorted(spark, sf_dir):
    """Sorted unique values (years available)."""
    return trade_once(spark, sf_dir).select("Year").distinct().orderBy("Year")


@query("scalar_lookup", with_ctes("""
SELECT * FROM trade WHERE Year = (
  SELECT Year FROM (SELECT Year, stddev_samp(PrimaryValue / nullif(Qty, 0)) AS sd FROM trade
                    WHERE flowDesc = 'Import' GROUP BY Year) ORDER BY sd DESC NULLS LAST, Year LIMIT 1)""",
    "trade"), doubles=TRADE_D)
def scalar_lookup(spark, sf_dir):
    """Year with the most volatile import price, used as a scalar in the next filter (no collect)."""
    t = trade(spark, sf_dir)
    sd = (t.where(F.col("flowDesc") == "Import")
           .groupBy("Year").agg(F.stddev_samp(X.safe_div("PrimaryValue", "Qty")).alias("sd")))
    year = sd.orderBy(F.col("sd").desc_nulls_last(), "Year").limit(1).select("Year").scalar()
    return t.where(F.col("Year") == year)


# --- 2.8 scalar functions ----------------------------------------------------------


@query("fn_string", with_ctes(r"""
SELECT Country, flowDesc, Year,
       Country || ' - ' || flowDesc AS label,
       Country || flowCode AS code,
       regexp_replace(Country, '_', ' ', 'g') AS spaced,
       regexp_replace(flowDesc || '_Waste', '_Waste$', '') AS stripped,
       regexp_matches(Country, '[13579]$') AS odd_nation,
       array_to_string(list_transform(string_split(lower(regexp_replace(Country, '_', ' ', 'g')), ' '),
                                      lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title
FROM trade""", "trade"))
def fn_string(spark, sf_dir):
    """paste, paste0, gsub, str_remove (anchored), grepl, toTitleCase."""
    t = trade_once(spark, sf_dir)
    c = F.col("Country")
    spaced = F.regexp_replace(c, "_", " ")
    return t.select("Country", "flowDesc", "Year",
                    F.concat_ws(" - ", c, F.col("flowDesc")).alias("label"),
                    F.concat(c, F.col("flowCode")).alias("code"),
                    spaced.alias("spaced"),
                    F.regexp_replace(F.concat(F.col("flowDesc"), F.lit("_Waste")), "_Waste$", "").alias("stripped"),
                    c.rlike("[13579]$").alias("odd_nation"),
                    F.initcap(spaced).alias("title"))


@query("fn_number_format", with_ctes("""
SELECT Country, Year, round_even(Percent_Own_Processed, 1) + 0.0 AS pct_1dp,
       CASE WHEN Import_Value IS NULL THEN 'n/a'
            ELSE format('{:,}', CAST(round_even(round(Import_Value, 2), 0) AS BIGINT)) END AS import_value_fmt
FROM waste""", "waste"), doubles={"pct_1dp": 1})
def fn_number_format(spark, sf_dir):
    """round (half-even), thousands separator, 'n/a' for missing."""
    w = waste(spark, sf_dir)
    return w.select("Country", "Year", X.round_half_even("Percent_Own_Processed", 1).alias("pct_1dp"),
                    X.big_mark("Import_Value", pre_round=2).alias("import_value_fmt"))


@query("fn_math", with_ctes("""
SELECT Year, Country, flowDesc, sqrt(abs(Qty)) AS sqrt_abs, pow(Qty, 2) AS sq,
       log10(PrimaryValue) AS log_value, abs(Qty - PrimaryValue / 2000.0) AS abs_gap,
       PrimaryValue / nullif(Qty, 0) AS ratio
FROM trade WHERE PrimaryValue > 0""", "trade"),
       doubles={"sqrt_abs": 6, "sq": 2, "log_value": 9, "abs_gap": 6, "ratio": 6})
def fn_math(spark, sf_dir):
    """sqrt, abs, ^, log10, safe division."""
    t = trade_once(spark, sf_dir).where(F.col("PrimaryValue") > 0)
    q, v = F.col("Qty"), F.col("PrimaryValue")
    return t.select("Year", "Country", "flowDesc", F.sqrt(F.abs(q)).alias("sqrt_abs"), F.pow(q, 2).alias("sq"),
                    F.log10(v).alias("log_value"), F.abs(q - v / 2000.0).alias("abs_gap"),
                    X.safe_div(v, q).alias("ratio"))


@query("fn_null", with_ctes("""
SELECT Year, Country, flowDesc, Qty IS NULL AS qty_missing, coalesce(Qty, -1.0) AS qty_or_flag,
       (PrimaryValue / nullif(Qty, 0)) IS NULL OR isnan(PrimaryValue / nullif(Qty, 0)) AS ratio_unusable
FROM trade""", "trade"), doubles={"qty_or_flag": 6})
def fn_null(spark, sf_dir):
    """is.na, coalesce, replace_na, is.finite-style test."""
    t = trade_once(spark, sf_dir)
    ratio = X.safe_div("PrimaryValue", "Qty")
    return t.select("Year", "Country", "flowDesc", F.col("Qty").isNull().alias("qty_missing"),
                    F.coalesce("Qty", F.lit(-1.0)).alias("qty_or_flag"),
                    (ratio.isNull() | F.isnan(ratio)).alias("ratio_unusable"))
