"""Grouped aggregates and per-group statistics.

Plain group aggregates (sum/avg/count/min/max/stddev) are split by Spark into
a map-side partial aggregate and a final one, so only one row per group and
task crosses the shuffle.  Exact median / quartiles are rank selections over
slices of about equal counts (``exact_quantiles``): no group is ever merged in
one task.  Statistics that are attached back to every row use a window over the
group instead of aggregate + self-join (one shuffle instead of two).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import safe_div, sum0


def sum_by(df: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """``summarise(out = sum(x, na.rm=TRUE))`` for each ``out: x``; all-NULL → 0."""
    return df.groupBy(*keys).agg(*[sum0(src).alias(out) for out, src in values.items()])


BUCKETS = 256
ACCURACY = 4096     # rank error of the cut points: one part in so many


def cut_points(value: Column | str, slices: int = BUCKETS) -> Column:
    """Aggregate: values that cut a group into ``slices`` of about equal
    counts whatever its distribution, from a mergeable quantile sketch of
    bounded size (map-side combine).  Where exactly they fall does not matter
    to what is computed over the slices."""
    return F.array_distinct(F.percentile_approx(value, [i / slices for i in range(1, slices)] or [0.5], ACCURACY))


def slice_of(value: Column, cuts: Column, slices: int = BUCKETS) -> Column:
    """Number of cut points below ``value``, by binary search."""
    steps = F.sequence(F.lit(1), F.lit(max(slices, 2).bit_length() + 1))
    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))

    def halve(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = (a["lo"] < a["hi"]) & (F.get(cuts, mid) < value)
        return F.struct(F.when(below, mid + 1).otherwise(a["lo"]).alias("lo"),
                        F.when(below | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))
    return F.aggregate(steps, start, halve, lambda a: a["lo"])


def sliced_counts(df: DataFrame, keys: Sequence[str], value: Column, buckets: int = BUCKETS) -> DataFrame:
    """Distinct values per group with their slice: ``_k`` (struct of the
    keys), ``_v, _c`` (count), ``_n`` (rows of the group), ``_b``.  NULL and
    NaN are left out.

    Equal values are counted with map-side combine, so one repeated any number
    of times is one row.  A slice holds about one part in ``buckets`` of its
    group's distinct values; the cut points are joined on the group's key,
    where adaptive execution splits a hot group's rows."""
    counts = (df.select(F.struct(*keys).alias("_k"), value.cast("double").alias("_v"))
              .where(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c")))
    cuts = counts.groupBy("_k").agg(cut_points("_v", buckets).alias("_cuts"), F.sum("_c").alias("_n"))
    return counts.join(cuts, "_k").withColumn("_b", slice_of(F.col("_v"), F.col("_cuts"), buckets)).drop("_cuts")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column,
                    probs: Sequence[float] = (0.5,), buckets: int = BUCKETS) -> DataFrame:
    """Exact quantiles (linear interpolation, R type 7) per group.

    One path at every size and for any distribution, without a driver action:

    1. each group's distinct values are cut into ``buckets`` slices of about
       equal counts (``sliced_counts``);
    2. the slices' counts, running per group, tell in which slice each wanted
       rank ⌊p(n−1)⌋ and ⌈p(n−1)⌉ lies;
    3. only the values of those slices are ordered, per (group, slice), and
       the rows at the ranks are picked.

    No task orders more of a group than one slice: an outlier takes a slice of
    its own instead of pressing the others into one.  NULL and NaN are missing
    (R's ``na.rm``).  Returns ``keys…, p, q``; groups without a value are
    absent.  NULL keys form a group like others.
    """
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    sliced = sliced_counts(df, keys, v, buckets)
    running = Window.partitionBy("_k").orderBy("_b")
    slices = (sliced.groupBy("_k", "_b").agg(F.sum("_c").alias("_c"), F.first("_n").alias("_n"))
              .withColumn("_before", F.sum("_c").over(running) - F.col("_c")))
    wanted = (slices.withColumn("p", F.explode(F.array(*[F.lit(float(x)) for x in probs])))
              .withColumn("_pos", (F.col("_n") - 1) * F.col("p"))
              .withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))))
              .where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_c")))
              .groupBy("_k", "_b", "_before").agg(F.collect_list(F.struct("p", "_pos", "_r")).alias("_w")))
    inside = Window.partitionBy("_k", "_b").orderBy("_v")
    picked = (sliced.select("_k", "_b", "_v", "_c").join(wanted, ["_k", "_b"])
              .withColumn("_from", F.col("_before") + F.sum("_c").over(inside) - F.col("_c"))
              .select("_k", "_v", "_c", "_from", F.explode("_w").alias("_w"))
              .where((F.col("_w._r") >= F.col("_from")) & (F.col("_w._r") < F.col("_from") + F.col("_c"))))
    g = picked.groupBy("_k", F.col("_w.p").alias("p")).agg(
        F.first("_w._pos").alias("_pos"), F.min("_w._r").alias("_lo"), F.max("_w._r").alias("_hi"),
        F.min("_v").alias("_vlo"), F.max("_v").alias("_vhi"))
    q = F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(
        (F.col("_hi") - F.col("_pos")) * F.col("_vlo") + (F.col("_pos") - F.col("_lo")) * F.col("_vhi"))
    return g.select(*[F.col("_k")[k].alias(k) for k in keys], "p", q.alias("q"))


def median_by(df: DataFrame, keys: Sequence[str], value: str | Column, out: str) -> DataFrame:
    """Exact median per group (see ``exact_quantiles``); every group of
    ``df`` is returned, NULL where it has no value.  The medians are joined to
    the groups with NULL keys matching."""
    keys = list(keys)
    m = exact_quantiles(df, keys, value, (0.5,)).select(F.struct(*keys).alias("_k"), F.col("q").alias(out))
    groups = df.select(F.struct(*keys).alias("_k")).distinct().join(m, "_k", "left")
    return groups.select(*[F.col("_k")[k].alias(k) for k in keys], out)


def sd_by(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Sample standard deviation; one row → NULL (as R ``sd``)."""
    return df.groupBy(*keys).agg(F.stddev_samp(value).alias(out))


def share_of_total(df: DataFrame, partition: Sequence[str], value: str, out: str) -> DataFrame:
    """``x / sum(x)`` within the partition, as a window (no self-join)."""
    total = F.sum(value).over(Window.partitionBy(*partition))
    return df.withColumn(out, safe_div(F.col(value), total))


def first_index_where(df: DataFrame, keys: Sequence[str], index: str, cond: Column, out: str) -> DataFrame:
    """Earliest index at which ``cond`` holds, per key (NULL if never)."""
    return df.groupBy(*keys).agg(F.min(F.when(cond, F.col(index))).alias(out))


def all_null(cols: Sequence[str]) -> Column:
    """Aggregate: TRUE when every listed column is NULL in every row."""
    return F.bool_and(F.coalesce(*[F.col(c) for c in cols]).isNull())


def keep_groups_min_size(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Keep series with at least ``n`` rows (count over the key window)."""
    return (df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
              .where(F.col("_n") >= n).drop("_n"))


def nonnull_count(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.count(value).over(Window.partitionBy(*keys)))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles (type 7), IQR whiskers clipped to the data inside the fences,
    and the number of points beyond them, per group.

    Two aggregates over the same grouping: quartiles first, then a join on
    the group keys (one row per group) for the fences.
    """
    qs = exact_quantiles(df, keys, value, (0.25, 0.5, 0.75))
    q = qs.groupBy(*keys).agg(*[F.first(F.when(F.col("p") == p, F.col("q")), ignorenulls=True).alias(n)
                                for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
          .withColumn("lo_fence", F.col("q1") - 1.5 * F.col("iqr"))
          .withColumn("hi_fence", F.col("q3") + 1.5 * F.col("iqr")))
    v = F.col(value)
    inside = (v >= F.col("lo_fence")) & (v <= F.col("hi_fence"))
    j = df.join(q, on=list(keys), how="inner")
    return j.groupBy(*keys, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, v)).alias("whisker_lo"),
        F.max(F.when(inside, v)).alias("whisker_hi"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max], right-closed with the minimum in the
    first bin (R ``hist`` with ``include.lowest``)."""
    w = Window.partitionBy(*keys) if keys else None
    if w is None:
        lo = df.agg(F.min(value)).scalar()
        hi = df.agg(F.max(value)).scalar()
    else:
        lo, hi = F.min(value).over(w), F.max(value).over(w)
    width = (hi - lo) / F.lit(float(bins))
    raw = F.ceil(safe_div(F.col(value) - lo, width))
    b = F.least(F.greatest(F.coalesce(raw, F.lit(1)), F.lit(1)), F.lit(bins)).cast("int")
    binned = df.where(F.col(value).isNotNull()).withColumn("bin", b).withColumn("_lo", lo).withColumn("_w", width)
    return (binned.groupBy(*keys, "bin")
                  .agg(F.count(F.lit(1)).alias("count"),
                       F.first(F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("bin_lo"),
                       F.first(F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_hi")))


def running_sum(df: DataFrame, partition: Sequence[str], order: Sequence[Column | str], value: str,
                out: str) -> DataFrame:
    """Cumulative sum in order within the partition (stack tops)."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))
