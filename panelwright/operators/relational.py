"""Joins, lookups, distinct and top-n.

Join strategy is left to Catalyst + AQE: with runtime statistics a side below
``spark.sql.autoBroadcastJoinThreshold`` becomes a broadcast hash join, larger
sides stay sort-merge and skewed partitions are split.  ``broadcast()`` is
only applied to sides whose size is bounded by construction (``bounded=True``:
literal dictionaries, top-n lists, one-row scalars).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import normalised_name  # noqa: F401 (the lookup key of this module's joins)


def _maybe_broadcast(df: DataFrame, bounded: bool) -> DataFrame:
    return F.broadcast(df) if bounded else df


def join_lookup(df: DataFrame, dim: DataFrame, on: Sequence[str] | str, how: str = "left",
                bounded: bool = False, null_safe: bool = False) -> DataFrame:
    """Equi-join on same-named keys; ``null_safe`` makes NULL keys match (R's
    default), via ``<=>`` which is still a hash-join key."""
    keys = [on] if isinstance(on, str) else list(on)
    dim = _maybe_broadcast(dim, bounded)
    if not null_safe:
        return df.join(dim, on=keys, how=how)
    r = dim.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in dim.columns])
    cond = [df[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return df.join(r, on=cond, how=how).drop(*[f"_r_{k}" for k in keys])


def join_renamed(df: DataFrame, dim: DataFrame, left_key: str, right_key: str,
                 how: str = "left") -> DataFrame:
    """``by = c(a = b)``: keep the left key, drop the right one."""
    return df.join(dim, df[left_key] == dim[right_key], how).drop(dim[right_key])


def join_coalesce(left: DataFrame, right: DataFrame, on: Sequence[str], prefer: str = "y",
                  how: str = "left") -> DataFrame:
    """Same-named non-key columns: ``.x``/``.y`` suffixes, then one column
    ``coalesce(y, x)`` (``prefer="y"``) per name."""
    on = list(on)
    common = [c for c in left.columns if c in right.columns and c not in on]
    lx = left.select(*on, *[F.col(c).alias(f"{c}.x") if c in common else F.col(c)
                            for c in left.columns if c not in on])
    ry = right.select(*on, *[F.col(c).alias(f"{c}.y") if c in common else F.col(c)
                             for c in right.columns if c not in on])
    j = lx.join(ry, on=on, how=how)
    for c in common:
        a, b = (f"`{c}.y`", f"`{c}.x`") if prefer == "y" else (f"`{c}.x`", f"`{c}.y`")
        j = j.withColumn(c, F.coalesce(F.col(a), F.col(b))).drop(f"{c}.x", f"{c}.y")
    return j


def semi_join(df: DataFrame, keys_df: DataFrame, on: Sequence[str] | str, bounded: bool = False) -> DataFrame:
    return df.join(_maybe_broadcast(keys_df, bounded), on=on, how="left_semi")


def unmatched_report(df: DataFrame, key_col: str, name_col: str) -> DataFrame:
    """Total / matched / failed counts attached to each failed name (one row
    per failed name, counts repeated) — the name bridge's printed report
    without gathering the names into one list.  The counts are one aggregate
    (a one-row scalar)."""
    miss = F.col(key_col).isNull()
    n = df.agg(F.struct(F.count(F.lit(1)).alias("total"), F.count(F.when(~miss, 1)).alias("matched"))).scalar()
    return (df.where(miss).select(F.col(name_col).alias("failed_name"), n.alias("_n"))
            .select("failed_name", F.col("_n.total").alias("total"), F.col("_n.matched").alias("matched"),
                    (F.col("_n.total") - F.col("_n.matched")).alias("failed")))


def lookup_dictionary(df: DataFrame, dictionary: DataFrame, column: str, out: str,
                      alias_col: str = "alias", canonical_col: str = "canonical") -> DataFrame:
    """alias → canonical, else the name itself.  The dictionary is
    de-duplicated first (a repeated alias must not duplicate rows)."""
    d = (dictionary.groupBy(alias_col).agg(F.min(canonical_col).alias("_canon"))
                   .withColumnRenamed(alias_col, "_alias"))
    j = df.join(d, df[column] == d["_alias"], "left")
    return j.withColumn(out, F.coalesce(F.col("_canon"), F.col(column))).drop("_alias", "_canon")


def distinct_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``distinct(keys, .keep_all=TRUE)`` with a deterministic 'first'."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """First n rows after sort, no ties (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def top_n_with_ties(df: DataFrame, n: int, by: str, descending: bool = True,
                    partition: Sequence[str] = ()) -> DataFrame:
    """``slice_max/slice_min(by, n)``: keeps ties (rank ≤ n).

    Per group: ``rank()`` over the group window.  Globally no single-partition
    window is used: the n-th value is found by a bounded top-n
    (TakeOrderedAndProject, n rows) as a scalar subquery, and the table is
    filtered against it — rank ≤ n holds exactly for rows not worse than the
    n-th value.
    """
    c = F.col(by)
    order = c.desc() if descending else c.asc()
    if partition:
        w = Window.partitionBy(*partition).orderBy(order)
        return df.withColumn("_rk", F.rank().over(w)).where(F.col("_rk") <= n).drop("_rk")
    head = df.where(c.isNotNull()).orderBy(order).limit(n)
    nth = head.agg(F.min(by) if descending else F.max(by)).scalar()
    return df.where(c >= nth) if descending else df.where(c <= nth)
