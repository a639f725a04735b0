"""Fit once, use often: a stored model table per series table.

Each model is fitted on its first use and written to the shared checkpoint
folder, one row per series.  Forecasts, interval bounds and scenario paths read
that table; none of them fits again, whatever the horizon, the number of paths
or the seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import md5_uniform
from ..operators import arima
from ..operators import forecast as fc
from ..session import cut_lineage

MODELS = ("MEAN", "NAIVE", "ETS", "ARIMA")


def _simple_fit(df: DataFrame, keys: Sequence[str], index: str, value: str, model: str) -> DataFrame:
    """MEAN or NAIVE: base value, variance of one step, residuals in order."""
    rows = df.where(F.col(value).isNotNull()).select(
        F.struct(*keys).alias("_key"), F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v")).alias("_x"))
    s = rows.groupBy("_key").agg(F.array_sort(F.collect_list("_x")).alias("_y"), F.avg("_x.v").alias("_mean"), F.var_samp("_x.v").alias("_var"),
                                 F.max("_x.i").alias("_last"))
    if model == "MEAN":
        return s.select("_key", "_last", F.col("_mean").alias("base"), (F.col("_var") * (F.lit(1.0) + F.lit(1.0) / F.size("_y"))).alias("variance"),
                        F.transform("_y", lambda x: x["v"] - F.col("_mean")).alias("resid"))
    s = s.withColumn("resid", F.expr("transform(slice(_y, 2, size(_y)), (x, i) -> x.v - _y[i].v)"))
    return s.select("_key", "_last", F.element_at("_y", -1)["v"].alias("base"),
                    F.expr("aggregate(resid, 0D, (s, x) -> s + x * x) / nullif(size(resid), 0)").alias("variance"), "resid")


class ModelTable:
    """Stored fits of the models of one series table ``(keys…, index, value)``."""

    def __init__(self, series: DataFrame, keys: Sequence[str], index: str, value: str):
        self.series, self.keys, self.index, self.value = series, list(keys), index, value
        self._fits: dict[str, DataFrame] = {}

    def fit(self, model: str) -> DataFrame:
        """The stored model table of one model."""
        if model not in MODELS:
            raise ValueError(f"model must be one of {MODELS}")
        if model not in self._fits:
            args = (self.series, self.keys, self.index, self.value)
            made = arima.arima_fit(*args) if model == "ARIMA" else fc.ets_fit(*args) if model == "ETS" else _simple_fit(*args, model)
            self._fits[model] = cut_lineage(made, f"model-{model}")
        return self._fits[model]

    def forecast(self, h: int, models: Sequence[str] = MODELS) -> DataFrame:
        """``keys…, model, index, mean, variance``."""
        out = None
        for model in models:
            one = self._forecast(model, h).select(*self.keys, "model", self.index, "mean", "variance")
            out = one if out is None else out.unionByName(one)
        return out

    def _forecast(self, model: str, h: int) -> DataFrame:
        fit = self.fit(model)
        if model == "ARIMA":
            return arima.arima_forecast(fit, self.keys, self.index, h)
        if model == "ETS":
            return fc.ets_forecast(fit, self.keys, self.index, h)
        out = fit.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(h))))
        steps = F.col("_j") if model == "NAIVE" else F.lit(1)
        return out.select(*self._key_columns(), F.lit(model).alias("model"), (F.col("_last") + F.col("_j")).alias(self.index),
                          F.col("base").alias("mean"), (F.col("variance") * steps).alias("variance"))

    def _key_columns(self) -> list:
        return [F.col("_key")[k].alias(k) for k in self.keys]

    def intervals(self, h: int, models: Sequence[str] = MODELS) -> DataFrame:
        return fc.intervals(self.forecast(h, models))

    def paths(self, model: str, h: int, times: int = 1, seed: int = 123) -> DataFrame:
        """``keys…, path, index, sim``: bootstrap futures of MEAN, NAIVE or
        ARIMA, each step driven by the residual at position floor(u·m)."""
        fit = self.fit(model)
        if model == "ARIMA":
            return arima.arima_futures(fit, self.keys, self.index, h, times, seed)
        if model == "ETS":
            raise ValueError("paths are drawn from MEAN, NAIVE or ARIMA")
        out = fit.where(F.size("resid") > 0).withColumn("path", F.explode(F.sequence(F.lit(1), F.lit(times))))
        u = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda j: md5_uniform(
            *[F.col("_key")[k] for k in self.keys], F.col("path"), F.col("_last") + j, seed=seed))
        out = out.withColumn("_u", u).withColumn("_e", F.expr("transform(_u, x -> resid[cast(floor(x * size(resid)) AS int)])"))
        sim = "aggregate(slice(_e, 1, j), base, (s, x) -> s + x)" if model == "NAIVE" else "base + _e[j - 1]"
        out = out.withColumn("x", F.explode(F.expr(f"transform(sequence(1, {int(h)}), j -> named_struct('j', j, 'sim', {sim}))")))
        return out.select(*self._key_columns(), "path", (F.col("_last") + F.col("x.j")).alias(self.index), F.col("x.sim").alias("sim"))
