"""Losses of forecasts, as aggregates and as pointwise expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from volspan.functions.numeric import ratio


def mse(a: str = "actual", f: str = "forecast") -> Column:
    return F.avg(F.pow(F.col(a) - F.col(f), 2))


def mae(a: str = "actual", f: str = "forecast") -> Column:
    return F.avg(F.abs(F.col(a) - F.col(f)))


def qlike(a: str = "actual", f: str = "forecast") -> Column:
    """Mean of r - ln r - 1, r = actual / forecast, over rows where both are positive."""
    r = F.when((F.col(a) > 0) & (F.col(f) > 0), F.try_divide(F.col(a), F.col(f)))
    return F.avg(r - F.ln(r) - 1)


def r2_oos(a: str = "actual", f: str = "forecast", benchmark: str | None = None) -> Column:
    """1 - SSE / SSB; the benchmark is a column, or else the mean of the actuals. 0 where SSB is 0."""
    sse = F.sum(F.pow(F.col(a) - F.col(f), 2))
    ssb = F.var_pop(a) * F.count(a) if benchmark is None else F.sum(F.pow(F.col(a) - F.col(benchmark), 2))
    return F.when(ssb == 0, 0.0).otherwise(1 - ratio(sse, ssb))


def all_losses(a: str = "actual", f: str = "forecast") -> list[Column]:
    return [mse(a, f).alias("MSE"), mae(a, f).alias("MAE"), qlike(a, f).alias("QLIKE"), r2_oos(a, f).alias("R2OOS")]


def loss_series(kind: str = "QLIKE", a: str = "actual", f: str = "forecast", floor: float | Column = 1e-10) -> Column:
    """Loss of each row. QLIKE floors the forecast and the ratio, and so keeps every row."""
    actual, forecast = F.col(a), F.col(f)
    if kind == "MSE":
        return F.pow(actual - forecast, 2)
    if kind == "MAE":
        return F.abs(actual - forecast)
    if kind != "QLIKE":
        raise ValueError(f"unknown loss: {kind}")
    low = floor if isinstance(floor, Column) else F.lit(floor)
    r = F.greatest(actual / F.greatest(forecast, low), low)
    return F.when(actual.isNotNull() & forecast.isNotNull(), r - F.ln(r) - 1)
