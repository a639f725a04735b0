"""Trade imputation: outlier blanking, reference prices, unit-price series,
quantity / value back-calculation and flags.

Plan shape for ``impute_trade``: one aggregate for the reference price (one
row per flow, joined back — AQE broadcasts it after measuring it), one
Exchange on the series keys, one Sort, one Window for the whole price chain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import if_else3
from .aggregate import median_by
from .timeseries import fill_chain_expr

QTY, VAL = "Qty", "PrimaryValue"


def blank_outliers(df: DataFrame, max_price: float = 5.0, min_qty: float = 1000.0,
                   qty_scale: float = 1.0, blank: str = "both", qty: str = QTY,
                   val: str = VAL) -> DataFrame:
    """Price above ``max_price`` or quantity below ``min_qty`` → NULL.

    ``raw_price = if(q > 0, v / (q·scale), 0)``; ``is_outlier = raw_price >
    max_price OR q·scale < min_qty`` with R's three-valued logic, so a NULL in
    either measure blanks both (reference behaviour).  ``blank="qty"`` only
    blanks the quantity, which leaves imputation something to work from.
    """
    q, v = F.col(qty), F.col(val)
    raw_price = if_else3(q > 0, v / (q * F.lit(qty_scale)), F.lit(0.0))
    is_out = (raw_price > F.lit(max_price)) | ((q * F.lit(qty_scale)) < F.lit(min_qty))
    df = df.withColumn("Raw_Unit_Price", raw_price).withColumn("is_outlier", is_out)
    df = df.withColumn(qty, if_else3(F.col("is_outlier"), F.lit(None).cast("double"), q))
    if blank == "both":
        df = df.withColumn(val, if_else3(F.col("is_outlier"), F.lit(None).cast("double"), v))
    return df


def reference_price(df: DataFrame, by: Sequence[str] = ("flowDesc",), qty: str = QTY,
                    val: str = VAL, out: str = "global_unit_price") -> DataFrame:
    """Exact median unit price of rows with both measures positive, per flow."""
    ok = df.where((F.col(qty) > 0) & (F.col(val) > 0))
    return median_by(ok, list(by), F.col(val) / F.col(qty), out)


def unit_price(df: DataFrame, keys: Sequence[str] = ("Country", "flowDesc"), index: str = "Year",
               price_ref: DataFrame | None = None, by: Sequence[str] = ("flowDesc",),
               qty: str = QTY, val: str = VAL) -> DataFrame:
    """Observed price → interpolate (x = index) → locf → nocb → global fallback."""
    if price_ref is None:
        price_ref = reference_price(df, by, qty, val)
    df = df.join(price_ref, on=list(by), how="left")
    q, v = F.col(qty), F.col(val)
    observed = q.isNotNull() & (q > 0) & v.isNotNull() & (v > 0)
    df = df.withColumn("unit_price_raw", F.when(observed, v / q))
    df = df.withColumn("unit_price_interp", fill_chain_expr("unit_price_raw", list(keys), index))
    return df.withColumn("unit_price_final", F.coalesce("unit_price_interp", "global_unit_price"))


def impute_quantity(df: DataFrame, strict_na: bool = False, qty: str = QTY, val: str = VAL,
                    price: str = "unit_price_final", out: str = "Qty_filled") -> DataFrame:
    """Quantity := value / price when missing, or 0 while value > 0.

    Default is the guarded form (a 0 quantity with unknown value stays 0);
    ``strict_na=True`` is the batch form, where that case yields NULL.
    """
    q, v, p = F.col(qty), F.col(val), F.col(price)
    if strict_na:
        cond = (q.isNull() | ((q == 0) & (v > 0))) & p.isNotNull() & (p > 0)
    else:
        cond = ((q.isNull() | ((q == 0) & v.isNotNull() & (v > 0))) & v.isNotNull()
                & p.isNotNull() & (p > 0))
    return df.withColumn(out, if_else3(cond, v / p, q))


def impute_value(df: DataFrame, qty: str = "Qty_filled", val: str = VAL,
                 price: str = "unit_price_final", out: str = "PrimaryValue_filled") -> DataFrame:
    """Value := imputed quantity × price when the value is missing."""
    q, v, p = F.col(qty), F.col(val), F.col(price)
    cond = v.isNull() & q.isNotNull() & p.isNotNull()
    return df.withColumn(out, F.when(cond, q * p).otherwise(v))


def imputation_flags(df: DataFrame, qty: str = QTY, val: str = VAL, qty_filled: str = "Qty_filled",
                     val_filled: str = "PrimaryValue_filled") -> DataFrame:
    """Flags as in the app: a raw 0 that stays 0 also counts as imputed."""
    q = F.col(qty)
    return (df.withColumn("Qty_imputed_flag", (q.isNull() | (q == 0)) & F.col(qty_filled).isNotNull())
              .withColumn("Value_imputed_flag", F.col(val).isNull() & F.col(val_filled).isNotNull()))


def impute_trade(df: DataFrame, keys: Sequence[str] = ("Country", "flowDesc"), index: str = "Year",
                 strict_na: bool = False) -> DataFrame:
    """Full imputation: reference price, price chain, quantity, value, flags."""
    df = unit_price(df, keys, index)
    df = impute_quantity(df, strict_na=strict_na)
    df = impute_value(df)
    return imputation_flags(df)
