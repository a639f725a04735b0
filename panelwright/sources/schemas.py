"""Explicit schemas of the panel files (never ``inferSchema``)."""

from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField,
                               StructType)


def _s(*cols) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


S, I, D = StringType(), IntegerType(), DoubleType()

TRADE = _s(("Year", I), ("CountryCode", S), ("Country", S), ("flowCode", S), ("flowDesc", S),
           ("Qty", D), ("PrimaryValue", D))

RECYCLING = _s(("LOCATION_CODES", S), ("Location", S), ("TIME_PERIOD", I), ("PLASTICS_CODES", S),
               ("OBS_VALUE", D))

COUNTRY_BRIDGE = _s(("Country", S), ("OECD_Code", S), ("WB_Code", S), ("WB_Name", S))

OECD_MAPPING = _s(("Country", S), ("OECD_Code", S))

NAME_FIXES = _s(("alias", S), ("canonical", S))

GDP = _s(("WB_Code", S), ("Country", S), ("Year", I), ("GDP", D))

WASTE = _s(("Country", S), ("Year", I), ("Est_Waste_Produced", D), ("Est_Recycled_Amount", D),
           ("Regional_Recycling_Rate", D), ("Imports", D), ("Exports", D), ("Import_Value", D),
           ("Export_Value", D), ("Processed_Own_Waste", D), ("Processed_Others_Waste", D),
           ("Percent_Own_Processed", D))

FORECAST_LONG = _s(("Country", S), ("Variable", S), ("Year", I), ("Amount", D))

PRESCRIPTIVE = _s(("Country", S), ("Year", I), ("Percent_Own_Processed", D), ("Local_Industry_Value", D))

GROWTH = _s(("LOCATION_CODES", S), ("Location", S), ("Gradient", D))

LEADERBOARD = _s(("Approach", S), ("Model", S), ("RMSE", D), ("MAE", D), ("MAPE", D))

COUNTRY_DIM = _s(("CountryCode", S), ("name", S))

BY_NAME = {
    "trade": TRADE, "recycling": RECYCLING, "country_bridge": COUNTRY_BRIDGE,
    "oecd_mapping": OECD_MAPPING, "name_fixes": NAME_FIXES, "gdp": GDP, "waste": WASTE,
    "forecast_long": FORECAST_LONG, "prescriptive": PRESCRIPTIVE, "growth": GROWTH,
    "leaderboard": LEADERBOARD, "country_dim": COUNTRY_DIM,
}
