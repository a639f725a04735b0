"""Column-expression helpers.

Every helper returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen.  The R semantics they reproduce are listed in
SURVEY §1.4 (S1–S12).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.lit(v)


# --- three-valued logic -------------------------------------------------------

def if_else3(cond: Column, yes, no) -> Column:
    """R ``if_else``: a NULL condition yields NULL instead of the ``no`` branch (S1)."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, lit_or_col(yes)).otherwise(lit_or_col(no))


def case_when(*branches, default=None) -> Column:
    """Ordered ``case_when``: ``branches`` are (condition, value) pairs."""
    out = None
    for cond, value in branches:
        out = F.when(cond, lit_or_col(value)) if out is None else out.when(cond, lit_or_col(value))
    return out.otherwise(lit_or_col(default)) if default is not None else out


# --- null-preserving clamps (S4) ------------------------------------------------

def pmax(x: ColumnOrName, bound) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, lit_or_col(bound)))


def pmin(x: ColumnOrName, bound) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.least(x, lit_or_col(bound)))


def clamp(x: ColumnOrName, lo=None, hi=None) -> Column:
    out = col(x)
    if lo is not None:
        out = pmax(out, lo)
    if hi is not None:
        out = pmin(out, hi)
    return out


# --- arithmetic --------------------------------------------------------------

def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division where x/0 gives NULL (R gives Inf/NaN; ANSI Spark raises) (S3)."""
    return F.try_divide(col(num), col(den))


def is_finite(x: ColumnOrName) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def sum0(x: ColumnOrName) -> Column:
    """``sum(na.rm=TRUE)``: an all-NULL group sums to 0 (S2)."""
    return F.coalesce(F.sum(col(x)), F.lit(0.0))


def any_null(*cols: ColumnOrName) -> Column:
    return reduce(lambda a, b: a | b, [col(c).isNull() for c in cols])


# --- deterministic randomness -------------------------------------------------

TWO_32 = 4294967296.0


def md5_uniform(*parts: ColumnOrName, seed: int = 0) -> Column:
    """Uniform in (0, 1) from md5 of the key parts and a seed.

    Depends only on the row's key, never on partitioning or task order, so a
    recomputed partition (lost executor) draws the same numbers.
    """
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts], F.lit(str(seed)))
    word = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (word + F.lit(0.5)) / F.lit(TWO_32)


def std_normal(*parts: ColumnOrName, seed: int = 0) -> Column:
    """Box–Muller normal draw from two independent md5 uniforms."""
    u1 = md5_uniform(*parts, F.lit("u1"), seed=seed)
    u2 = md5_uniform(*parts, F.lit("u2"), seed=seed)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# --- normal distribution -------------------------------------------------------

# Abramowitz & Stegun 26.2.17 polynomial for the normal CDF
# (absolute error below 7.5e-8).
AS_P = 0.2316419
AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)


def norm_pdf(z: ColumnOrName) -> Column:
    z = col(z)
    return F.lit(INV_SQRT_2PI) * F.exp(F.lit(-0.5) * z * z)


def norm_cdf(z: ColumnOrName) -> Column:
    z = col(z)
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * a)
    poly = t * (F.lit(AS_B[0]) + t * (F.lit(AS_B[1]) + t * (F.lit(AS_B[2]) + t * (F.lit(AS_B[3]) + t * F.lit(AS_B[4])))))
    upper = F.lit(1.0) - norm_pdf(a) * poly
    return F.when(z >= 0, upper).otherwise(F.lit(1.0) - upper)


# --- formatting -----------------------------------------------------------------

def round_half_even(x: ColumnOrName, digits: int = 0) -> Column:
    """R ``round`` (S8)."""
    return F.bround(col(x), digits)


def big_mark(x: ColumnOrName, missing: str = "n/a", pre_round: int | None = None) -> Column:
    """``format(round(x), big.mark=",")`` with a text for missing values.

    ``pre_round``: for money sums, round to that many decimals first, so a
    sum that is exactly at a half unit rounds the same whatever order its
    terms were added in.
    """
    v = col(x) if pre_round is None else F.round(col(x), pre_round)
    return F.coalesce(F.format_number(F.bround(v, 0) + F.lit(0.0), 0), F.lit(missing))


def round_significant(x: ColumnOrName, digits: int) -> Column:
    """Round to ``digits`` significant digits with exact powers of ten only
    (x / 10^k for k ≥ 0, x · 10^−k otherwise), so two engines given values
    that differ in their last float bits return the same double."""
    x = col(x)
    k = F.floor(F.log10(F.abs(x))) - F.lit(digits - 1)
    ten_k = F.pow(F.lit(10.0), k)
    ten_mk = F.pow(F.lit(10.0), -k)
    r = F.when(k >= 0, F.round(x / ten_k) * ten_k).otherwise(F.round(x * ten_mk) / ten_mk)
    return F.when(x.isNull() | (x == 0), x + F.lit(0.0)).otherwise(r + F.lit(0.0))


def _round_one(name: str, d):
    if isinstance(d, str) and d.startswith("sig"):
        return round_significant(name, int(d[3:]))
    return F.round(F.col(name), d) + F.lit(0.0)


def round_doubles(df, digits: int = 6, per_column: dict | None = None):
    """Round every DOUBLE column (result comparison is done on rounded values);
    ``per_column`` overrides the digits of single columns (an int, or
    ``"sigN"`` for N significant digits)."""
    from pyspark.sql.types import DoubleType, FloatType
    per_column = per_column or {}
    exprs = [_round_one(f.name, per_column.get(f.name, digits)).alias(f.name)
             if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
             for f in df.schema.fields]
    return df.select(*exprs)
