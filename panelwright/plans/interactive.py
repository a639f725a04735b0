"""The interactive forecast as one parameterised plan (E3).

Pick the series (or all of them), a training range, a model and a horizon; get
the training rows, the forecast with its bounds, the bridge between the last
actual and the first forecast, and the accuracy on whatever actuals lie in the
forecast periods.  Only the chosen model is planned and fitted, once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..session import cut_lineage
from . import evaluation as ev
from .model_table import ModelTable

MENU = ("ETS", "ARIMA", "MEAN")
MEASURES = ("value", "lo80", "hi80", "lo95", "hi95", "RMSE", "MAE", "MAPE")


def interactive_forecast(data: DataFrame, keys: Sequence[str], index: str, value: str, start, cutoff, model: str = "ETS",
                         h: int = 5, pick: Column | None = None) -> DataFrame:
    """``keys…, kind, model, index`` and the measures of each kind of row:
    train (value), forecast (value and bounds), bridge (value, two rows per
    series) and accuracy (RMSE, MAE, MAPE; no index; no row without an actual).

    ``pick`` slices the series before anything else is planned.  A series
    needs two rows within [``start``, ``cutoff``]; others have no rows.
    """
    if model not in MENU:
        raise ValueError(f"model must be one of {MENU}")
    keys = list(keys)
    rows = (data if pick is None else data.where(pick)).select(*keys, index, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    rows = cut_lineage(rows, "picked")                # read as training rows and as actuals
    train = fc.split_range(rows, keys, index, start, cutoff)
    forecast = cut_lineage(ModelTable(train, keys, index, "_v").intervals(h, (model,)), "interactive")
    out = [("train", train.withColumnRenamed("_v", "value")), ("forecast", forecast.withColumnRenamed("mean", "value"))]
    last = train.groupBy(*keys).agg(F.max_by("_v", index).alias("value"), F.max(index).alias(index))
    first = forecast.groupBy(*keys).agg(F.min_by("mean", index).alias("value"), F.min(index).alias(index))
    out.append(("bridge", last.unionByName(first)))
    out.append(("accuracy", ev.accuracy(ev.with_actual(forecast, rows, keys, index, "_v"), keys)))
    kind = data.schema[index].dataType
    tables = [t.select(*keys, F.lit(k).alias("kind"), F.lit(model).alias("model"),
                       F.col(index).cast(kind).alias(index) if index in t.columns else F.lit(None).cast(kind).alias(index),
                       *[F.col(m).cast("double").alias(m) if m in t.columns else F.lit(None).cast("double").alias(m) for m in MEASURES]) for k, t in out]
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result
