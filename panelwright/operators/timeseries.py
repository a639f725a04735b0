"""Keyed time-series operators: declare, fill gaps, interpolate, carry, roll.

A series is ``(keys…, index)`` with at most one row per key and index.  Every
window here is partitioned by the series keys (the reference's ungrouped
interpolation, which leaks across keys, is deliberately not reproduced), and
all window expressions of one operator share one partition/order spec, so the
plan is one Exchange on the keys, one Sort and one Window node.

Scale: the rows of a key are bounded by the length of its index range (years
or months), not by the input volume; the raw fact tables are aggregated to
this grain before any of these operators run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def _spec(keys: Keys, index: str):
    return Window.partitionBy(*keys).orderBy(index)


def _back(keys: Keys, index: str):
    return _spec(keys, index).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _fwd(keys: Keys, index: str):
    return _spec(keys, index).rowsBetween(Window.currentRow, Window.unboundedFollowing)


def duplicate_index_rows(df: DataFrame, keys: Keys, index: str) -> DataFrame:
    """(keys, index) pairs that occur more than once, with their count."""
    return (df.groupBy(*keys, index).agg(F.count(F.lit(1)).alias("n_rows"))
              .where(F.col("n_rows") > 1))


def declare_series(df: DataFrame, keys: Keys, index: str) -> DataFrame:
    """``as_tsibble``: a table whose plan fails when a key holds an index
    twice.  No job is run here: the index is compared with the one before it
    over the window that series operators use anyway (no further Exchange or
    Sort), and whatever reads the index carries the check."""
    twice = F.lag(index).over(_spec(keys, index)) == F.col(index)
    says = F.concat(F.lit(f"duplicate index rows for keys {list(keys)} / {index}: "), F.to_json(F.struct(*keys, index)))
    return df.withColumn(index, F.when(twice, F.raise_error(says)).otherwise(F.col(index)))


def once_each(rows: str) -> Column:
    """A series' collected rows (structs with index ``i``), failing the query if an index is there twice."""
    twice = F.size(F.array_distinct(F.transform(rows, lambda x: x["i"]))) < F.size(rows)
    return F.when(twice, F.raise_error(F.lit("duplicate index rows in a series"))).otherwise(F.col(rows))


def fill_gaps(df: DataFrame, keys: Keys, index: str) -> DataFrame:
    """Insert the missing index values of each key between its own min and
    max; inserted rows have NULL measures.  A key that holds an index twice
    makes the query fail (see ``declare_series``)."""
    # each row also stands for the gap up to the next row of its key
    after = F.lead(index).over(_spec(keys, index))
    twice = F.raise_error(F.lit(f"duplicate index rows for keys {list(keys)} / {index}"))
    upto = F.when(after == F.col(index), twice).otherwise(F.coalesce(after - 1, F.col(index)))
    rest = [c for c in df.columns if c not in (*keys, index)]
    wide = df.withColumn("_upto", upto).withColumn("_at", F.explode(F.sequence(F.col(index), F.col("_upto"))))
    return wide.select(*keys, F.col("_at").alias(index),
                       *[F.when(F.col("_at") == F.col(index), F.col(c)).alias(c) for c in rest])


def _interp_expr(value: str, x: Column, keys: Keys, index: str) -> tuple[Column, Column, Column]:
    has = F.col(value).isNotNull()
    px = F.last(F.when(has, x), ignorenulls=True).over(_back(keys, index))
    pv = F.last(value, ignorenulls=True).over(_back(keys, index))
    nx = F.first(F.when(has, x), ignorenulls=True).over(_fwd(keys, index))
    nv = F.first(value, ignorenulls=True).over(_fwd(keys, index))
    inner = pv + (nv - pv) * (x - px).cast("double") / (nx - px).cast("double")
    interp = F.when(has, F.col(value)).when(px.isNotNull() & nx.isNotNull() & (nx > px), inner)
    return interp, pv, nv


def interpolate(df: DataFrame, keys: Keys, index: str, value: str, out: str | None = None,
                x: str | None = None, rule: int = 1) -> DataFrame:
    """``zoo::na.approx``: linear interpolation of interior NULLs.

    ``x``: abscissa column (default the index).  ``rule=1`` leaves leading and
    trailing NULLs; ``rule=2`` extends the nearest observation flat.
    """
    out = out or value
    xc = F.col(x) if x else F.col(index)
    interp, pv, nv = _interp_expr(value, xc, keys, index)
    if rule == 2:
        interp = F.coalesce(interp, pv, nv)
    return df.withColumn(out, interp)


def interpolate_position(df: DataFrame, keys: Keys, index: str, value: str,
                         out: str | None = None, rule: int = 1) -> DataFrame:
    """na.approx without ``x``: the abscissa is the row position in the key."""
    tmp = "_pos"
    df = df.withColumn(tmp, F.row_number().over(_spec(keys, index)))
    return interpolate(df, keys, index, value, out, x=tmp, rule=rule).drop(tmp)


def locf(df: DataFrame, keys: Keys, index: str, value: str, out: str | None = None) -> DataFrame:
    """``na.locf``: carry the last observation forward."""
    return df.withColumn(out or value, F.last(value, ignorenulls=True).over(_back(keys, index)))


def nocb(df: DataFrame, keys: Keys, index: str, value: str, out: str | None = None) -> DataFrame:
    """``na.locf(fromLast=TRUE)``: carry the next observation backward."""
    return df.withColumn(out or value, F.first(value, ignorenulls=True).over(_fwd(keys, index)))


def fill_chain_expr(value: str, keys: Keys, index: str, x: str | None = None,
                    final=None) -> Column:
    """interp → locf → nocb (→ constant) as one column over one window spec."""
    interp, pv, nv = _interp_expr(value, F.col(x) if x else F.col(index), keys, index)
    parts = [interp, pv, nv] + ([F.lit(final)] if final is not None else [])
    return F.coalesce(*parts)


def fill_chain(df: DataFrame, keys: Keys, index: str, value: str, out: str | None = None,
               gaps: bool = True, final=0.0) -> DataFrame:
    """``fill_gaps → na.approx → locf → nocb → replace_na(final)``."""
    if gaps:
        df = fill_gaps(df, keys, index)
    return df.withColumn(out or value, fill_chain_expr(value, keys, index, final=final))


def roll_mean_right(df: DataFrame, keys: Keys, index: str, value: str, out: str,
                    width: int = 3) -> DataFrame:
    """``rollapply(width, mean, align="right", fill="extend")``.

    A window holding a NULL gives NULL (R ``mean`` without ``na.rm``); the
    first ``width-1`` rows take the first full window's value.
    """
    w = _spec(keys, index)
    frame = w.rowsBetween(-(width - 1), Window.currentRow)
    full = F.when(F.count(value).over(frame) == width, F.avg(value).over(frame))
    df = df.withColumn("_rn", F.row_number().over(w)).withColumn("_full", full)
    first_full = F.first(F.when(F.col("_rn") == width, F.col("_full")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (df.withColumn(out, F.when(F.col("_rn") >= width, F.col("_full")).otherwise(first_full))
              .drop("_rn", "_full"))
