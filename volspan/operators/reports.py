"""Reports over many series: metrics tables, robustness checks, summaries, figure data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspan.functions.losses import all_losses, loss_series, mse, r2_oos
from volspan.functions.numeric import ratio, t_two_sided_p
from volspan.operators.compare import GROUP, SERIES, align_forecasts, mz_recursive
from volspan.operators.features import lag

METRICS = ["MSE", "MAE", "QLIKE", "R2OOS"]


def series_metrics(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return df.groupBy(*keys).agg(*all_losses(), F.count("*").alias("n_obs"))


def metrics_by_asset(df: DataFrame) -> DataFrame:
    """Metrics of every series on the dates that all models of its group share."""
    return series_metrics(align_forecasts(df))


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("model", "horizon").agg(*[F.avg(m).alias(m) for m in METRICS])


def run_summary(df: DataFrame, digits: int = 4) -> DataFrame:
    """Mean QLIKE, R2 and MSE by horizon and model, each series on all of its own dates."""
    return series_metrics(df).groupBy("horizon", "model").agg(*[F.round(F.avg(m), digits).alias(m) for m in ("QLIKE", "R2OOS", "MSE")])


def mcs_summary(sets: DataFrame, digits: int = 3) -> DataFrame:
    share = F.avg(F.col("in_mcs").cast("double"))
    return sets.groupBy("model", "horizon").agg(F.round(share, digits).alias("pct_in_mcs"), F.round(F.avg("mcs_pvalue"), digits).alias("avg_pvalue"), F.count("*").alias("n_assets"))


MZ_STATS = ["alpha", "alpha_se", "alpha_pval", "beta", "beta_se", "beta_pval", "R2", "F_stat", "F_pval"]


def mz_summary(table: DataFrame, least: int = 50) -> DataFrame:
    return table.where(F.col("n") >= least).groupBy("model", "horizon").agg(*[F.avg(c).alias(c) for c in MZ_STATS], F.avg((F.col("F_pval") < 0.05).cast("double")).alias("pct_reject_05"))


def gr_summary(tests: DataFrame, least: int = 100) -> DataFrame:
    return tests.where(F.col("T") >= least).groupBy("model", "horizon").agg(F.avg("sup_stat").alias("avg_sup_stat"), F.max("sup_stat").alias("max_sup_stat"), F.avg(F.col("reject_5").cast("double")).alias("pct_reject_05"), F.count("*").alias("n_assets"))


def gr_mean_path(path: DataFrame) -> DataFrame:
    """Mean rolling statistic by place in the path, dated by the longest series."""
    return path.groupBy("model", "horizon", "rel_pos").agg(F.avg("statistic").alias("statistic"), F.max_by("date", F.struct("T", "symbol")).alias("date"))


def top_models(summary: DataFrame, n: int = 8, by: str = "avg_sup_stat") -> DataFrame:
    w = Window.partitionBy("horizon").orderBy(F.desc(by), "model")
    return summary.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def floor_sensitivity(df: DataFrame, floors: Sequence[float] = (1e-4, 1e-6, 1e-8, 1e-10), digits: int = 4) -> DataFrame:
    """Mean and median over assets of the mean floored QLIKE, for each floor."""
    spread = align_forecasts(df).withColumn("floor", F.explode(F.array(*[F.lit(x) for x in floors])))
    mean = spread.groupBy("floor", *SERIES).agg(F.avg(loss_series(floor=F.col("floor"))).alias("loss"))
    return mean.groupBy("floor", "horizon", "model").agg(F.round(F.avg("loss"), digits).alias("mean_QLIKE"), F.round(F.percentile("loss", F.lit(0.5)), digits).alias("median_QLIKE"), F.count("*").alias("n_assets"))


def average_rank(column: str, keys: Sequence[str]) -> Column:
    ties = F.count("*").over(Window.partitionBy(*keys, column))
    return F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (ties - 1) / 2


def floor_spearman(table: DataFrame, base: float = 1e-10) -> DataFrame:
    """Rank correlation of the models under each floor with those under `base`, for more than two models."""
    ranked = table.withColumn("rank", average_rank("mean_QLIKE", ["floor", "horizon"]))
    own = ranked.where(F.col("floor") == base).select("horizon", "model", F.col("rank").alias("base_rank"))
    return ranked.join(own, ["horizon", "model"]).groupBy("floor", "horizon").agg(F.when(F.count("*") > 2, F.corr("rank", "base_rank")).alias("spearman"))


def pivot_by(table: DataFrame, rows: Sequence[str], column: str, values: Sequence, value: str) -> DataFrame:
    return table.groupBy(*rows).pivot(column, list(values)).agg(F.first(value))


def mz_corrected_metrics(df: DataFrame, corrected_models: Sequence[str], least: int = 252) -> DataFrame:
    """Metrics after row `least` of each longer series: originals, and for `corrected_models` recursively corrected forecasts.

    Corrected forecasts are floored at the larger of 1e-10 and 1 % of the series' least positive actual.
    """
    x = mz_recursive(df, least)
    low = F.min(F.when(F.col("actual") > 0, F.col("actual"))).over(Window.partitionBy(*SERIES))
    x = x.withColumn("low", F.greatest(F.coalesce(low * 0.01, F.lit(1e-10)), F.lit(1e-10))).where(F.col("pos") >= least)
    wanted = F.when(F.col("model").isin(*corrected_models), F.array(F.struct(F.lit("original").alias("variant"), F.col("forecast").alias("f")), F.struct(F.lit("corrected").alias("variant"), F.greatest("corrected", "low").alias("f"))))
    x = x.withColumn("v", F.explode(F.coalesce(wanted, F.array(F.struct(F.lit("original").alias("variant"), F.col("forecast").alias("f"))))))
    x = x.select(*SERIES, "v.variant", "actual", F.col("v.f").alias("forecast"))
    return x.groupBy(*SERIES, "variant").agg(mse().alias("MSE"), F.avg(loss_series()).alias("QLIKE"), r2_oos().alias("R2OOS"))


def mz_corrected_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("model", "horizon", "variant").agg(*[F.avg(m).alias(m) for m in ("MSE", "QLIKE", "R2OOS")])


def window_comparison(df: DataFrame, windows: Sequence[int] = (252, 512), least: int = 10) -> DataFrame:
    """Mean metrics by model and training window side by side, and the window with the lower QLIKE. `df` has a column `window`."""
    per = series_metrics(df, [*SERIES, "window"]).where(F.col("n_obs") >= least)
    wide = per.groupBy("model", "horizon").pivot("window", list(windows)).agg(*[F.avg(m).alias(m) for m in METRICS])
    a, b = windows
    better = F.when(F.col(f"{b}_QLIKE") < F.col(f"{a}_QLIKE"), b).when(F.col(f"{a}_QLIKE").isNotNull(), a)
    return wide.withColumn("better", better)


def period_split(df: DataFrame, split: str = "2020-03-01") -> DataFrame:
    """Adds `period`: pre for dates before `split`, else post."""
    return df.withColumn("period", F.when(F.col("date") < F.to_date(F.lit(split)), "pre").otherwise("post"))


def subsample_metrics(df: DataFrame, split: str = "2020-03-01", least: int = 10) -> DataFrame:
    """Metrics before and after a date, averaged over the assets with enough rows."""
    per = series_metrics(period_split(df, split), [*SERIES, "period"]).where(F.col("n_obs") >= least)
    return per.groupBy("model", "horizon", "period").agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("n_tickers"))


def class_metrics(metrics: DataFrame, classes: DataFrame, how: str = "mean") -> DataFrame:
    """Mean or median over the assets of each class; `classes` is (symbol, asset_class)."""
    agg = (lambda m: F.avg(m)) if how == "mean" else (lambda m: F.percentile(m, F.lit(0.5)))
    return metrics.join(classes, "symbol").groupBy("asset_class", "model", "horizon").agg(*[agg(m).alias(m) for m in METRICS])


def flag_best(table: DataFrame, models: DataFrame, panel: Sequence[str] = ("horizon",), qlike_limit: float = 1.0) -> DataFrame:
    """Flags of the best model of each panel: least MSE, MAE and QLIKE (below the limit), largest R2.

    On ties the first model in the order of `models` (model, ord) wins. `dagger` marks a QLIKE above the limit.
    """
    t = table.join(models.select("model", "ord"), "model")

    def best(value: Column) -> Column:
        first = F.row_number().over(Window.partitionBy(*panel).orderBy(value.asc_nulls_last(), "ord"))
        return value.isNotNull() & (first == 1)

    below = F.when(F.col("QLIKE") < qlike_limit, F.col("QLIKE"))
    return t.select(*table.columns, best(F.col("MSE")).alias("best_MSE"), best(F.col("MAE")).alias("best_MAE"), best(below).alias("best_QLIKE"), best(-F.col("R2OOS")).alias("best_R2OOS"), (F.col("QLIKE") > qlike_limit).alias("dagger"))


#: Factors by asset class: MSE, MAE.
SCALES = {"stocks": (1e6, 1e4), "fx": (1e8, 1e4), "futures": (1e6, 1e3)}


def scale_metrics(table: DataFrame, scales: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    scales = SCALES if scales is None else scales
    pick = lambda i: F.coalesce(*[F.when(F.col("asset_class") == k, v[i]) for k, v in scales.items()], F.lit(1.0))
    return table.withColumns({"MSE": F.col("MSE") * pick(0), "MAE": F.col("MAE") * pick(1)})


def mcs_rates(sets: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Percent of assets with the model in the set, a column per horizon; 0 where the model is absent."""
    share = F.avg(F.col("in_mcs").cast("double")) * 100
    wide = sets.groupBy("model").pivot("horizon", list(horizons)).agg(share)
    return wide.na.fill(0.0).select("model", *[F.col(str(h)).alias(f"h{h}") for h in horizons])


def dm_win_rate(pairs: DataFrame, metrics: DataFrame, n_models: int = 15, level: float = 0.05) -> DataFrame:
    """Percent of the (n_models - 1) x assets comparisons in which the model's loss is significantly and truly lower.

    `pairs` holds each pair once with its two-sided p-value; the asset's QLIKE tells who won.
    """
    q = metrics.select(*SERIES, "QLIKE")
    sided = pairs.select(*GROUP, "model_i", "model_j", "p_value")
    x = sided.join(q.withColumnsRenamed({"model": "model_i", "QLIKE": "q_i"}), [*GROUP, "model_i"]).join(q.withColumnsRenamed({"model": "model_j", "QLIKE": "q_j"}), [*GROUP, "model_j"])
    winner = F.when(F.col("q_i") < F.col("q_j"), F.col("model_i")).when(F.col("q_j") < F.col("q_i"), F.col("model_j"))
    wins = x.where(F.col("p_value") < level).select("horizon", winner.alias("model")).where("model is not null").groupBy("model", "horizon").agg(F.count("*").alias("wins"))
    assets = metrics.groupBy("horizon").agg(F.count_distinct("symbol").alias("assets"))
    everyone = metrics.select("model", "horizon").distinct().join(assets, "horizon")
    return everyone.join(wins, ["model", "horizon"], "left").select("model", "horizon", F.coalesce("wins", F.lit(0)).alias("wins"), (100.0 * F.coalesce("wins", F.lit(0)) / ((n_models - 1) * F.col("assets"))).alias("win_rate"))


def model_order(table: DataFrame, models: DataFrame) -> DataFrame:
    """Known models only, with display name and their place `ord` in the fixed order."""
    return table.join(models.select("model", "display", "ord"), "model")


def recent_common(df: DataFrame, models: Sequence[str], symbols: Sequence[str], n: int = 500) -> DataFrame:
    """The last `n` dates that all of the models share, wide: actual and a column per model."""
    x = df.where(F.col("model").isin(*models) & F.col("symbol").isin(*symbols))
    wide = x.groupBy("symbol", "date").pivot("model", list(models)).agg(F.first("forecast"))
    first = x.where(F.col("model") == models[0]).select("symbol", "date", "actual")
    wide = wide.dropna(subset=list(models)).join(first, ["symbol", "date"])
    w = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return wide.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back")


def mcs_matrix(sets: DataFrame, classes: DataFrame, class_order: Sequence[str], models: Sequence[str], horizon: int = 1) -> DataFrame:
    """Assets x models of set membership; `class_ord` is the place of the asset's class."""
    wide = sets.where(F.col("horizon") == horizon).groupBy("symbol").pivot("model", list(models)).agg(F.max(F.col("in_mcs").cast("int"))).na.fill(0)
    place = F.coalesce(*[F.when(F.col("asset_class") == c, i) for i, c in enumerate(class_order)], F.lit(len(class_order)))
    return wide.join(classes, "symbol").withColumn("class_ord", place)


def qlike_ratio(metrics: DataFrame, base: str = "HAR") -> DataFrame:
    """Each model's QLIKE over that of `base`, per asset and horizon."""
    own = metrics.where(F.col("model") == base).select(*GROUP, F.col("QLIKE").alias("base"))
    return metrics.where(F.col("model") != base).join(own, GROUP).select(*SERIES, ratio(F.col("QLIKE"), F.col("base")).alias("ratio"))


def ratio_quantiles(ratios: DataFrame) -> DataFrame:
    q = F.percentile("ratio", F.array(*[F.lit(x) for x in (0.01, 0.25, 0.5, 0.75, 0.99)]))
    x = ratios.groupBy("model", "horizon").agg(q.alias("q"), F.avg((F.col("ratio") < 1).cast("double")).alias("frac_below_1"))
    names = ["p01", "p25", "median", "p75", "p99"]
    return x.select("model", "horizon", *[F.col("q")[i].alias(n) for i, n in enumerate(names)], "frac_below_1")


def autocorr1(panel: DataFrame, column: str = "rv", least: int = 100) -> DataFrame:
    """Correlation of a symbol's values with those of the row before."""
    x = panel.withColumn("before", lag(column))
    return x.groupBy("symbol").agg(F.corr(column, "before").alias("rho1"), F.count("*").alias("n")).where(F.col("n") > least).select("symbol", "rho1")


def persistence_regression(ratios: DataFrame, rho: DataFrame) -> DataFrame:
    """Per model: ratio ~ 1 + rho1 over the assets: slope, intercept, r, two-sided t p-value of the slope."""
    x = ratios.join(rho, "symbol").groupBy("model", "horizon").agg(F.regr_slope("ratio", "rho1").alias("slope"), F.regr_intercept("ratio", "rho1").alias("intercept"), F.corr("ratio", "rho1").alias("r"), F.count("*").alias("n"))
    t = F.when((F.col("n") > 2) & (F.abs("r") < 1), F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))

    return x.withColumn("p_value", F.when(t.isNotNull(), t_two_sided_p(t, F.col("n") - 2)))


def persistence_split(ratios: DataFrame, rho: DataFrame) -> DataFrame:
    """Median ratio and share below 1 of the assets above and at or below the median autocorrelation."""
    middle = rho.agg(F.percentile("rho1", F.lit(0.5)).alias("middle"))
    x = ratios.join(rho, "symbol").crossJoin(F.broadcast(middle))  # one row
    half = F.when(F.col("rho1") > F.col("middle"), "high").otherwise("low")
    return x.groupBy("model", "horizon", half.alias("half")).agg(F.percentile("ratio", F.lit(0.5)).alias("median_ratio"), F.avg((F.col("ratio") < 1).cast("double")).alias("frac_below_1"), F.count("*").alias("n"))


def min_obs(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with at least `least` rows."""
    return df.withColumn("rows of the group", F.count("*").over(Window.partitionBy(*keys))).where(F.col("rows of the group") >= least).drop("rows of the group")
