"""§2.3 joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.names import resolve_names
from ..operators import relational as rel
from ..plans import prescriptive as pr
from ..sources import bindings as b
from .common import WASTE_DIGITS, trade, trade_and_totals, waste
from .registry import query
from .sqlbind import register, with_ctes

TRADE_D = {"Qty": 6, "PrimaryValue": 4}


@query("join_left_lookup", with_ctes("""
SELECT t.*, br.OECD_Code, br.WB_Code, br.WB_Name FROM trade t LEFT JOIN country_bridge br ON t.Country = br.Country""",
    "trade", "country_bridge"), doubles=TRADE_D)
def join_left_lookup(spark, sf_dir):
    """Trade rows ⟕ country bridge on the name."""
    return rel.join_lookup(trade(spark, sf_dir), b.country_bridge(spark, sf_dir), "Country")


@query("join_left_multi", with_ctes("""
SELECT e.*, t.Imports, t.Exports, t.Import_Value, t.Export_Value
FROM country_est e LEFT JOIN trade_wide t ON e.Country = t.Country AND e.Year = t.Year""",
    "country_est", "trade_wide"), doubles={k: WASTE_DIGITS[k] for k in (
        "Est_Waste_Produced", "Est_Recycled_Amount", "Regional_Recycling_Rate", "Imports", "Exports",
        "Import_Value", "Export_Value")})
def join_left_multi(spark, sf_dir):
    """Country estimates ⟕ wide trade on (Country, Year); unmatched stay NULL."""
    t_long, totals = trade_and_totals(spark, sf_dir)
    shares = pr.gdp_shares(pr.gdp_clean(b.gdp(spark, sf_dir), b.country_bridge(spark, sf_dir)))
    est = pr.country_estimates(shares, pr.regional_rates(b.recycling(spark, sf_dir, totals)))
    return est.join(pr.trade_wide(t_long), on=["Country", "Year"], how="left")


@query("join_inner_multi", with_ctes("SELECT * FROM country_est", "country_est"),
       doubles={k: 9 for k in ("Est_Waste_Produced", "Est_Recycled_Amount", "Regional_Recycling_Rate")})
def join_inner_multi(spark, sf_dir):
    """GDP shares ⋈ regional rates on (OECD_Code, Year)."""
    shares = pr.gdp_shares(pr.gdp_clean(b.gdp(spark, sf_dir), b.country_bridge(spark, sf_dir)))
    return pr.country_estimates(shares, pr.regional_rates(b.recycling(spark, sf_dir)))


@query("join_many_to_many", with_ctes("SELECT * FROM gdp_clean", "gdp_clean"), doubles={"GDP": 4})
def join_many_to_many(spark, sf_dir):
    """GDP ⋈ bridge on WB code; alias names duplicate GDP rows on purpose."""
    return pr.gdp_clean(b.gdp(spark, sf_dir), b.country_bridge(spark, sf_dir))


register("bridge_attempt", """
SELECT m.Country, m.OECD_Code, coalesce(f.canonical, m.Country) AS Match_Attempt_Name
FROM oecd_mapping m LEFT JOIN (SELECT alias, min(canonical) AS canonical FROM name_fixes GROUP BY alias) f
  ON m.Country = f.alias""", ("oecd_mapping", "name_fixes"))
register("bridge_built", """
SELECT a.Country, a.OECD_Code, a.Match_Attempt_Name, w.WB_Code, w.WB_Name
FROM bridge_attempt a LEFT JOIN wb_countries w ON a.Match_Attempt_Name = w.Join_Name""",
         ("bridge_attempt", "wb_countries"))


def bridge_attempt(spark, sf_dir):
    return rel.lookup_dictionary(b.oecd_mapping(spark, sf_dir), b.name_fixes(spark, sf_dir), "Country",
                                 "Match_Attempt_Name")


def bridge_built(spark, sf_dir):
    return rel.join_renamed(bridge_attempt(spark, sf_dir), b.wb_countries(spark, sf_dir),
                            "Match_Attempt_Name", "Join_Name")


@query("lookup_dictionary", with_ctes("SELECT * FROM bridge_attempt", "bridge_attempt"))
def lookup_dictionary(spark, sf_dir):
    """alias → canonical name, else the name itself (dictionary de-duplicated first)."""
    return bridge_attempt(spark, sf_dir)


@query("join_renamed_key", with_ctes("SELECT * FROM bridge_built", "bridge_built"))
def join_renamed_key(spark, sf_dir):
    """Left join on differently named keys (Match_Attempt_Name = Join_Name)."""
    return bridge_built(spark, sf_dir)


@query("join_unmatched_report", with_ctes("""
SELECT Country AS failed_name, (SELECT count(*) FROM bridge_built) AS total,
       (SELECT count(WB_Code) FROM bridge_built) AS matched,
       (SELECT count(*) FROM bridge_built) - (SELECT count(WB_Code) FROM bridge_built) AS failed
FROM bridge_built WHERE WB_Code IS NULL""", "bridge_built"))
def join_unmatched_report(spark, sf_dir):
    """Total / matched / failed counts with the names that failed."""
    return rel.unmatched_report(bridge_built(spark, sf_dir), "WB_Code", "Country")


@query("join_collide_coalesce", with_ctes("""
SELECT t.WB_Code, t.Year, t.flowCode, t.flowDesc, t.Qty, t.PrimaryValue, br.OECD_Code, br.WB_Name,
       coalesce(br.Country, t.Country) AS Country
FROM (SELECT * EXCLUDE (CountryCode), CountryCode AS WB_Code FROM trade) t
LEFT JOIN country_bridge br ON t.WB_Code = br.WB_Code""", "trade", "country_bridge"), doubles=TRADE_D)
def join_collide_coalesce(spark, sf_dir):
    """Trade (code renamed WB_Code) ⟕ bridge on the code; the two Country
    columns become ``.x``/``.y`` and then ``coalesce(y, x)``."""
    t = trade(spark, sf_dir).withColumnRenamed("CountryCode", "WB_Code")
    return rel.join_coalesce(t, b.country_bridge(spark, sf_dir), on=["WB_Code"], prefer="y")


@query("join_full_outer", with_ctes("""
SELECT coalesce(w.Country, t.Country) AS Country, coalesce(w.Year, t.Year) AS Year,
       w.Est_Waste_Produced, t.Imports AS Trade_Imports
FROM waste w FULL JOIN trade_wide t ON w.Country = t.Country AND w.Year = t.Year""", "waste", "trade_wide"),
       doubles={"Est_Waste_Produced": 9, "Trade_Imports": 12})
def join_full_outer(spark, sf_dir):
    """Waste history ⟗ trade on (Country, Year): rows of either side kept."""
    t_long, totals = trade_and_totals(spark, sf_dir)
    w = waste(spark, sf_dir, t_long, totals).select("Country", "Year", "Est_Waste_Produced")
    t = pr.trade_wide(t_long).select("Country", "Year", F.col("Imports").alias("Trade_Imports"))
    return w.join(t, on=["Country", "Year"], how="full")


register("snap_year", "SELECT max(Year) AS y FROM trade", ("trade",))


@query("join_star_metrics", with_ctes("""
SELECT d.CountryCode, d.name, t.Imports, t.Exports, w.Est_Waste_Produced, w.Percent_Own_Processed
FROM (SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS CountryCode, n_name AS name FROM nation) d
LEFT JOIN (SELECT * FROM trade_wide WHERE Year = (SELECT y FROM snap_year)) t ON d.name = t.Country
LEFT JOIN (SELECT * FROM waste WHERE Year = (SELECT y FROM snap_year)) w ON d.name = w.Country""",
    "trade_wide", "waste", "snap_year"),
       doubles={"Imports": 12, "Exports": 12, "Est_Waste_Produced": 9, "Percent_Own_Processed": 7})
def join_star_metrics(spark, sf_dir):
    """Country dimension ⟕ trade ⟕ waste for the latest year; dimension rows kept."""
    t_long, totals = trade_and_totals(spark, sf_dir)
    year = t_long.agg(F.max("Year")).scalar()
    dim = b.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("CountryCode"), F.col("n_name").alias("name"))
    t = pr.trade_wide(t_long).where(F.col("Year") == year).select(
        F.col("Country").alias("name"), "Imports", "Exports")
    w = waste(spark, sf_dir, t_long, totals).where(F.col("Year") == year).select(
        F.col("Country").alias("name"), "Est_Waste_Produced", "Percent_Own_Processed")
    return dim.join(t, "name", "left").join(w, "name", "left")


@query("join_semi_topn", with_ctes("""
SELECT t.* FROM trade t WHERE t.Country IN (
  SELECT Country FROM trade GROUP BY Country ORDER BY stddev_samp(PrimaryValue) DESC NULLS LAST, Country LIMIT 5)""",
    "trade"), doubles=TRADE_D)
def join_semi_topn(spark, sf_dir):
    """Rows of the 5 countries with the most volatile trade value (left semi
    join against a bounded top-5, broadcast)."""
    t = trade(spark, sf_dir)
    top = rel.top_n(t.groupBy("Country").agg(F.stddev_samp("PrimaryValue").alias("sd")), 5,
                    [F.col("sd").desc_nulls_last(), F.col("Country")]).select("Country")
    return rel.semi_join(t, top, "Country", bounded=True)


_FOLDED = "regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', '', 'g')"


@query("lookup_iso3", with_ctes(f"""
SELECT m.Country, d.CountryCode AS iso3
FROM oecd_mapping m LEFT JOIN (
  SELECT 'N' || CAST(n_nationkey AS VARCHAR) AS CountryCode, {_FOLDED.format("n_name")} AS key FROM nation) d
ON {_FOLDED.format("m.Country")} = d.key""", "oecd_mapping"))
def lookup_iso3(spark, sf_dir):
    """Country name in any spelling (case, accents, punctuation) → code, through a folded key."""
    m = b.oecd_mapping(spark, sf_dir)
    d = b.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("iso3"),
        rel.normalised_name("n_name").alias("_key"))
    return (m.join(d, rel.normalised_name(m["Country"]) == d["_key"], "left")
             .select("Country", "iso3"))


# spellings as trade files have them: accents, added words, another word order, and names that are none
_SPELLED = """
SELECT n_nationkey, unnest([translate(n_name, 'AEIOU', 'ÁÉÍÖÜ'), 'The ' || lower(n_name) || ' (...1998)',
  array_to_string(list_reverse(string_split(n_name, ' ')), ', ') || ' Rep.', 'Isle ' || n_nationkey]) AS raw FROM nation"""


@query("lookup_name_patterns", f"""
WITH s AS ({_SPELLED}),
w AS (SELECT *, string_split(trim(regexp_replace(lower(strip_accents(raw)), '[^a-z0-9]+', ' ', 'g')), ' ') AS has FROM s),
k AS (SELECT n_name, string_split(trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM nation),
m AS (SELECT w.raw, n_name, len(words) AS n, array_to_string(has, '') = array_to_string(words, '') AS same FROM w JOIN k
  ON len(list_filter(words, lambda x: len(list_filter(has, lambda h: starts_with(h, x))) > 0)) = len(words)),
b AS (SELECT raw, arg_min(n_name, {{'s': NOT same, 'n': -n, 'm': n_name}}) AS canonical, bool_or(same) AS same FROM m GROUP BY raw)
SELECT s.n_nationkey, s.raw, canonical, CASE WHEN same THEN 'name' WHEN canonical IS NOT NULL THEN 'pattern' END AS matched_by
FROM s LEFT JOIN b ON s.raw = b.raw""")
def lookup_name_patterns(spark, sf_dir):
    """Names as trade files spell them → canonical names by folded key, then by
    ordered patterns met on word beginnings; unmatched names keep a NULL."""
    n = b.table(spark, sf_dir, "nation")
    spelled = F.array(F.translate("n_name", "AEIOU", "ÁÉÍÖÜ"), F.concat(F.lit("The "), F.lower("n_name"), F.lit(" (...1998)")),
                      F.concat(F.array_join(F.reverse(F.split("n_name", " ")), ", "), F.lit(" Rep.")),
                      F.concat(F.lit("Isle "), F.col("n_nationkey").cast("string")))
    return resolve_names(n.select("n_nationkey", F.explode(spelled).alias("raw")), "raw", n, "n_name")
