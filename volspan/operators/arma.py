"""Long-memory and ARMA tools on log variance.

The ARMA forecast is a two-stage regression estimate (a long autoregression, then the
lags and the lagged residuals), so that all symbols and refits are fitted by grouped
aggregates; its values differ from exact maximum likelihood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volspan.functions.numeric import clip_low
from volspan.operators.features import LOG_FLOOR, position, target
from volspan.operators.walk import ols_fit, test_rows, train_rows
from volspan.sources.panel import observed

PI = 3.141592653589793


def gph_d(df: DataFrame, column: str = "log_rv", limit: float = 0.49) -> DataFrame:
    """Log-periodogram estimate of the memory parameter per symbol, from floor(sqrt n) low frequencies."""
    w = Window.partitionBy("symbol")
    x = observed(df, column).withColumn("t", position()).withColumn("n", F.count("*").over(w)).withColumn("e", F.col(column) - F.avg(column).over(w))
    x = x.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt("n")))))
    angle = F.lit(2 * PI) * F.col("j") / F.col("n") * F.col("t")
    spectrum = x.groupBy("symbol", "n", "j").agg(F.sum(F.col("e") * F.cos(angle)).alias("re"), F.sum(F.col("e") * F.sin(angle)).alias("im"))
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.lit(2 * PI) * F.col("n"))
    omega = F.lit(2 * PI) * F.col("j") / F.col("n")
    points = spectrum.select("symbol", F.ln(power).alias("y"), (-2 * F.ln(2 * F.sin(omega / 2))).alias("x"))
    return points.groupBy("symbol").agg(F.greatest(F.least(F.regr_slope("y", "x"), F.lit(limit)), F.lit(-limit)).alias("d"))


def fracdiff_weights(d: float, lags: int) -> list[float]:
    out = [1.0]
    for k in range(1, lags + 1):
        out.append(-out[-1] * (d - k + 1) / k)
    return out


def fracdiff(df: DataFrame, d: float, lags: int = 100, column: str = "log_rv") -> DataFrame:
    """Fractional difference with `lags` terms; the first `lags` rows of a symbol go.

    Symbols with no more than `lags` rows use all they have for their last row.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    x = observed(df, column).withColumn("pos", position()).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    x = x.withColumn("held", F.collect_list(column).over(w.rowsBetween(-lags, 0)))
    weights = F.array(*[F.lit(v) for v in fracdiff_weights(d, lags)])
    value = F.aggregate(F.zip_with(F.reverse("held"), F.slice(weights, 1, F.size("held")), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return x.where(F.col("pos") >= F.least(F.lit(lags), F.col("n") - 1)).select("symbol", "date", value.alias("fracdiff"))


def arma_walk_forward(df: DataFrame, horizon: int = 1, train: int = 252, test: int = 126, step: int = 126, every: int = 22, p: int = 2, q: int = 2, long_ar: int = 6, least: int = 50) -> DataFrame:
    """ARMA(p, q) forecasts of variance: symbol, date, fold, refit, actual, forecast.

    Refitted every `every` test rows on the fold's rows so far; the forecast is the first
    step after the last refit's origin, for every horizon, and so constant between refits.
    The actual is complete means only. Where that fit fails (collinear or too few rows) an
    AR(1) of the same rows takes its place.
    """
    rows = observed(df, "rv").withColumn("actual", target("rv", horizon)).withColumn("pos", position())
    rows = rows.withColumn("y", F.ln(clip_low(F.col("rv"), LOG_FLOOR)))
    refits = -(-test // every)
    keys = ["symbol", "fold", "refit"]
    x = train_rows(rows.select("symbol", "date", "pos", "y"), train + test, step)
    x = x.withColumn("refit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(refits - 1).cast("long"))))
    origin = F.col("fold") * step + train + F.col("refit") * every
    x = x.where(F.col("pos") < origin)
    w = Window.partitionBy(*keys).orderBy("pos")
    ar = [f"y_{k}" for k in range(1, long_ar + 1)]
    x = x.withColumns({f"y_{k}": F.lag("y", k).over(w) for k in range(1, long_ar + 1)})
    first = ols_fit(x.dropna(subset=ar), keys, ar).select(*keys, F.col("const").alias("a_const"), *[F.col(f"b_{c}").alias(f"a_{c}") for c in ar])
    fitted = F.col("a_const")
    for c in ar:
        fitted = fitted + F.col(f"a_{c}") * F.col(c)
    x = x.join(first, keys).withColumn("e", F.col("y") - fitted)
    ma = [f"e_{k}" for k in range(1, q + 1)]
    x = x.withColumns({f"e_{k}": F.lag("e", k).over(w) for k in range(1, q + 1)})
    used = [*ar[:p], *ma]
    fit = ols_fit(x.dropna(subset=used), keys, used)
    last = x.groupBy(*keys).agg(F.max_by(F.struct("y", "e", *ar[: p - 1], *ma[: q - 1]), "pos").alias("last"), F.count("*").alias("rows"))
    value = F.col("const")
    for k in range(1, p + 1):
        value = value + F.col(f"b_y_{k}") * F.col("last.y" if k == 1 else f"last.y_{k - 1}")
    for k in range(1, q + 1):
        value = value + F.col(f"b_e_{k}") * F.col("last.e" if k == 1 else f"last.e_{k - 1}")
    plain = ols_fit(x.dropna(subset=["y_1"]), keys, ["y_1"]).select(*keys, F.col("const").alias("plain_const"), F.col("b_y_1").alias("plain_b"), F.col("sigma2").alias("plain_sigma2"))
    made = plain.join(fit, keys, "left").join(last, keys).where(F.col("rows") >= least)
    instead = F.exp(F.col("plain_const") + F.col("plain_b") * F.col("last.y") + F.col("plain_sigma2") / 2)
    made = made.select(*keys, F.coalesce(F.exp(value + F.col("sigma2") / 2), instead).alias("forecast"))
    tested = test_rows(rows, train, test, step).withColumn("refit", F.floor((F.col("pos") - F.col("fold") * step - train) / every)).where("actual is not null")
    return tested.join(made, keys).select(*keys[:1], "date", "fold", "refit", "actual", "forecast")


