"""Lagged and rolling regressors and forecast targets, as window expressions.

All windows count rows of a symbol in date order, so missing days must be filtered
out first (`sources.panel.observed`). All features of a model share one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspan.functions.numeric import clip_low
from volspan.sources.panel import observed

#: Regressor names by model.
REGRESSORS = {
    "HAR": ["x_d", "x_w", "x_m"],
    "HAR_J": ["x_d", "x_w", "x_m", "x_j"],
    "HAR_RS": ["g_d", "g_w", "g_m", "b_d", "b_w", "b_m"],
    "HARQ": ["x_d", "x_w", "x_m", "x_q"],
    "Log_HAR": ["x_d", "x_w", "x_m"],
}
LOG_FLOOR = 1e-10


def by_symbol():
    return Window.partitionBy("symbol").orderBy("date")


def position() -> Column:
    return (F.row_number().over(by_symbol()) - 1).cast("long")


def lag(column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(by_symbol())


def rolling_mean(column: str, window: int, shift: int = 0) -> Column:
    """Mean of `window` rows that end `shift` rows back; null until all of them exist."""
    w = by_symbol().rowsBetween(-(window - 1) - shift, -shift)
    return F.when(F.count(column).over(w) == window, F.avg(column).over(w))


def target(column: str = "rv", horizon: int = 1) -> Column:
    """Mean of the rows from the present one on; null if fewer than `horizon` are left."""
    if horizon == 1:
        return F.col(column)
    w = by_symbol().rowsBetween(0, horizon - 1)
    return F.when(F.count(column).over(w) == horizon, F.avg(column).over(w))


def har_features(df: DataFrame, daily: int = 1, weekly: int = 5, monthly: int = 22, column: str = "rv", prefix: str = "x") -> DataFrame:
    """Daily lag and weekly and monthly means of `column`, the means shifted by one row whatever the daily lag."""
    return df.withColumns({f"{prefix}_d": lag(column, daily), f"{prefix}_w": rolling_mean(column, weekly, 1), f"{prefix}_m": rolling_mean(column, monthly, 1)})


def har_j_features(df: DataFrame, **windows: int) -> DataFrame:
    """HAR and the lagged jump, on rows that have both measures."""
    return har_features(observed(df, "rv", "jump"), **windows).withColumn("x_j", lag("jump", windows.get("daily", 1)))


def har_rs_features(df: DataFrame, **windows: int) -> DataFrame:
    """Day, week and month of both semivariances."""
    df = observed(df, "rv", "good", "bad")
    return har_features(har_features(df, column="good", prefix="g", **windows), column="bad", prefix="b", **windows)


def harq_features(df: DataFrame, **windows: int) -> DataFrame:
    """HAR and the lagged variance times the root of the lagged quarticity."""
    daily = windows.get("daily", 1)
    return har_features(observed(df, "rv", "rq"), **windows).withColumn("x_q", lag("rv", daily) * F.sqrt(lag("rq", daily)))


def log_har_features(df: DataFrame, **windows: int) -> DataFrame:
    """Logs of the HAR regressors (of the averages), floored."""
    df = har_features(df, **windows)
    return df.withColumns({x: F.ln(clip_low(F.col(x), LOG_FLOOR)) for x in REGRESSORS["Log_HAR"]})


BUILDERS = {"HAR": har_features, "HAR_J": har_j_features, "HAR_RS": har_rs_features, "HARQ": harq_features, "Log_HAR": log_har_features}


def features_for_model(df: DataFrame, model: str, horizon: int = 1, **windows: int) -> DataFrame:
    """symbol, date, the model's regressors and `y` (log of the target for Log_HAR, with `actual` beside)."""
    df = BUILDERS[model](observed(df, "rv"), **windows).withColumn("actual", target("rv", horizon))
    y = F.ln(clip_low(F.col("actual"), LOG_FLOOR)) if model == "Log_HAR" else F.col("actual")
    return align(df.select("symbol", "date", *REGRESSORS[model], "actual", y.alias("y")), [*REGRESSORS[model], "y"])


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows complete in `columns`, numbered anew per symbol in `pos`."""
    return df.dropna(subset=columns).withColumn("pos", position())
