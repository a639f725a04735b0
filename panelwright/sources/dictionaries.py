"""Name dictionaries of the reference data model.

These are bounded literal tables (a few dozen rows), so joining against them
with ``broadcast`` is safe at any data size.  For the reference's own input
files, pass ``name_fixes_df(spark)`` to ``operators.relational.lookup_dictionary``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import NAME_FIXES

# UN trade country name -> World Bank country name, in the
# reference's order (one alias is listed twice, as in the reference).
NAME_FIXES_UN_TO_WB = [
    ("USA", "United States"),
    ("Viet Nam", "Vietnam"),
    ("Fed. Rep. of Germany (...1990)", "Germany"),
    ("Belgium-Luxembourg (...1998)", "Belgium"),
    ("Bosnia Herzegovina", "Bosnia and Herzegovina"),
    ("Rep. of Moldova", "Moldova"),
    ("Serbia and Montenegro (...2005)", "Serbia"),
    ("Faroe Isds", "Faroe Islands"),
    ("State of Palestine", "West Bank and Gaza"),
    ("China, Macao SAR", "Macao SAR, China"),
    ("Bolivia (Plurinational State of)", "Bolivia"),
    ("China, Hong Kong SAR", "Hong Kong SAR, China"),
    ("Wallis and Futuna Isds", "Wallis and Futuna"),
    ("Cook Isds", "Cook Islands"),
    ("Solomon Isds", "Solomon Islands"),
    ("FS Micronesia", "Micronesia, Fed. Sts."),
    ("Congo", "Congo, Rep."),
    ("Dem. Rep. of the Congo", "Congo, Dem. Rep."),
    ("Gambia", "Gambia, The"),
    ("Côte d'Ivoire", "Cote d'Ivoire"),
    ("Sudan (...2011)", "Sudan"),
    ("United Rep. of Tanzania", "Tanzania"),
    ("Central African Rep.", "Central African Republic"),
    ("Saint Lucia", "St. Lucia"),
    ("Saint Kitts and Nevis", "St. Kitts and Nevis"),
    ("Saint Vincent and the Grenadines", "St. Vincent and the Grenadines"),
    ("Dominican Rep.", "Dominican Republic"),
    ("Bahamas", "Bahamas, The"),
    ("Turks and Caicos Isds", "Turks and Caicos Islands"),
    ("Curaçao", "Curacao"),
    ("Southern African Customs Union (...1999)", "South Africa"),
    ("Mayotte (Overseas France)", "France"),
    ("Guadeloupe (Overseas France)", "France"),
    ("Martinique (Overseas France)", "France"),
    ("Netherlands Antilles (...2010)", "Netherlands Antilles"),
    ("Cayman Isds", "Cayman Islands"),
    ("Korea, Rep.", "Korea, Rep."),
    ("Rep. of Korea", "Korea, Rep."),
    ("South Korea", "Korea, Rep."),
    ("Slovakia", "Slovak Republic"),
    ("Slovak Republic", "Slovak Republic"),
    ("Czechia", "Czech Republic"),
    ("Czech Republic", "Czech Republic"),
    ("Russia", "Russian Federation"),
    ("Russian Federation", "Russian Federation"),
    ("Türkiye", "Turkey"),
    ("Egypt", "Egypt, Arab Rep."),
    ("Iran", "Iran, Islamic Rep."),
    ("Venezuela", "Venezuela, RB"),
    ("Yemen", "Yemen, Rep."),
    ("Kyrgyzstan", "Kyrgyz Republic"),
    ("Lao People's Dem. Rep.", "Lao PDR"),
    ("Syria", "Syrian Arab Republic"),
    ("Viet Nam", "Vietnam"),
]

# Name cleaning applied before the ISO3 lookup in the app.
NAME_CLEAN_FOR_ISO3 = [
    ("USA", "United States of America"),
    ("Bosnia Herzegovina", "Bosnia and Herzegovina"),
    ("Central African Rep.", "Central African Republic"),
    ("Dem. Rep. of the Congo", "Democratic Republic of the Congo"),
    ("Dominican Rep.", "Dominican Republic"),
    ("Rep. of Korea", "South Korea"),
    ("Lao People's Dem. Rep.", "Laos"),
    ("Russian Federation", "Russia"),
]


def name_fixes_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAME_FIXES_UN_TO_WB, NAME_FIXES)


def name_clean_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAME_CLEAN_FOR_ISO3, NAME_FIXES)
