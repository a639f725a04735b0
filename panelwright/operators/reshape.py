"""Reshape and set operators: pivot, unpivot, complete, union, ordered category.

Pivots always take an explicit value list: without it Spark runs an extra
distinct job on the driver side of planning and the output schema depends on
the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_single(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
                 values: Sequence, agg: str = "first", fill=None) -> DataFrame:
    """``pivot_wider`` of one value column; one output column per value.  With
    ``agg="first"`` a cell must hold one row: two make the query fail."""
    def only(c):
        twice = F.raise_error(F.lit(f"pivot: more than one row for {list(ids)} and a value of {names_from}"))
        return F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.first(c, ignorenulls=True))
    fn = {"first": only, "sum": F.sum, "max": F.max, "min": F.min}[agg]
    out = df.groupBy(*ids).pivot(names_from, list(values)).agg(fn(values_from))
    if fill is not None:
        out = out.fillna(fill, subset=[str(v) for v in values])
    return out


def pivot_multi(df: DataFrame, ids: Sequence[str], names_from: str, values_from: Sequence[str],
                values: Sequence, agg: str = "sum", fill=None, sep: str = "_") -> DataFrame:
    """``pivot_wider(values_from = c(a, b))``: columns named ``a_<value>`` as in tidyr.

    Implemented as conditional aggregation (one pass, one shuffle on ``ids``)
    so the names are chosen here rather than renamed from Spark's
    ``<value>_<agg>`` form.
    """
    fn = {"sum": F.sum, "first": lambda c: F.first(c, ignorenulls=True), "max": F.max}[agg]
    exprs = []
    for v in values_from:
        for val in values:
            e = fn(F.when(F.col(names_from) == F.lit(val), F.col(v)))
            if fill is not None:
                e = F.coalesce(e, F.lit(fill))
            exprs.append(e.alias(f"{v}{sep}{val}"))
    return df.groupBy(*ids).agg(*exprs)


def unpivot_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], names_to: str = "name",
                 values_to: str = "value", drop_nulls: bool = False) -> DataFrame:
    """``pivot_longer``; NULL values are kept unless ``drop_nulls``."""
    out = df.unpivot(list(ids), list(cols), names_to, values_to)
    return out.where(F.col(values_to).isNotNull()) if drop_nulls else out


def complete_grid(df: DataFrame, dims: Sequence[str], fill: dict | None = None,
                  levels: dict[str, Sequence] | None = None) -> DataFrame:
    """``tidyr::complete``: every combination of the distinct values of
    ``dims`` that occur in ``df`` (NULL is a value), with the data where it
    exists; every row of ``df`` is kept.

    ``levels`` gives a dimension's values where they are known beforehand
    (years of a horizon, variable names), so they need not be read off the
    data.  The grid grows one dimension at a time: the rows so far are hashed
    over slots, each slot meets the level rows by an equi-join (no cross
    join), and the work is the size of the output.
    """
    dims = list(dims)
    levels = levels or {}
    spark = df.sparkSession
    slots = max(2 * spark.sparkContext.defaultParallelism, 2)

    def rows_of(d):
        if d in levels:
            return spark.createDataFrame([(x,) for x in levels[d]], df.select(d).schema)
        return df.select(d).distinct()
    grid = rows_of(dims[0])
    for d in dims[1:]:
        spread = grid.withColumn("_slot", F.pmod(F.xxhash64(*grid.columns), F.lit(slots)).cast("int"))
        each = rows_of(d).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        grid = spread.join(each, "_slot").drop("_slot")
    cells = grid.select(F.struct(*dims).alias("_cell"))
    rest = [c for c in df.columns if c not in dims]
    data = df.select(F.struct(*dims).alias("_cell"), *rest)
    out = cells.join(data, "_cell", "full" if levels else "left")
    out = out.select(*[F.col("_cell")[d].alias(d) for d in dims], *rest)
    return out.fillna(fill) if fill else out


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """``bind_rows``: UNION ALL by column name, missing columns NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def union_distinct(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.distinct()


def ordered_category(df: DataFrame, column: str, levels: Sequence[str], out: str) -> DataFrame:
    """``factor(levels=…)``: an explicit 1-based order column for sorting."""
    arr = F.array(*[F.lit(v) for v in levels])
    return df.withColumn(out, F.array_position(arr, F.col(column)).cast("int"))


def level_order(column: str | Column, levels: Sequence[str]) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.array_position(F.array(*[F.lit(v) for v in levels]), c).cast("int")
