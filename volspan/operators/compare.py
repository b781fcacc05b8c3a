"""Forecast comparison: alignment, Diebold-Mariano, Mincer-Zarnowitz, Giacomini-Rossi.

Forecasts are long: symbol, horizon, model, date, actual, forecast. Tests of one series are
grouped aggregates over lags and running sums, with one sort per series; tests of pairs are
worked out side by side within a symbol and horizon.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspan.functions.losses import loss_series
from volspan.functions.numeric import f2_tail, finite, normal_cdf, ratio, two_sided_p

GROUP = ["symbol", "horizon"]
SERIES = ["symbol", "horizon", "model"]


def finite_pairs(df: DataFrame) -> DataFrame:
    return df.where(finite(F.col("actual")) & finite(F.col("forecast")))


def align_forecasts(df: DataFrame) -> DataFrame:
    """Rows on the dates that all models of a symbol and horizon share; the actual of the first model by name."""
    df = df.dropna(subset=["actual", "forecast"])
    models = df.groupBy(*GROUP).agg(F.count_distinct("model").alias("models"))
    dates = df.groupBy(*GROUP, "date").agg(F.count_distinct("model").alias("here"), F.min_by("actual", "model").alias("common"))
    shared = dates.join(models, GROUP).where("here = models").select(*GROUP, "date", "common")
    return df.join(shared, [*GROUP, "date"]).select(*GROUP, "model", "date", F.col("common").alias("actual"), "forecast")


def losses(df: DataFrame, kind: str = "QLIKE", floor: float = 1e-10) -> DataFrame:
    return df.select(*SERIES, "date", loss_series(kind, floor=floor).alias("loss"))


def numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    return df.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("T", F.count("*").over(Window.partitionBy(*keys)))


def nw_variance(df: DataFrame, keys: Sequence[str], d: str, lags: Column, most: int) -> DataFrame:
    """Per group: `n`, `mean`, `gamma0` and the Newey-West `variance` of the mean of `d`.

    Bartlett weights up to `lags` (at most `most`); each autocovariance is a mean over its own T - k terms.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    mean = F.avg(d).over(Window.partitionBy(*keys))
    x = df.withColumn("dev", F.col(d) - mean).withColumn("lags", lags)
    x = x.withColumns({f"lag_{k}": F.col("dev") * F.lag("dev", k).over(w) for k in range(1, most + 1)})
    total = F.avg(F.pow("dev", 2))
    out = x.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), total.alias("gamma0"), F.first("lags").alias("lags"), *[F.avg(f"lag_{k}").alias(f"g_{k}") for k in range(1, most + 1)])
    v = F.col("gamma0")
    for k in range(1, most + 1):
        v = v + F.when(F.col("lags") >= k, 2 * (1 - k / (F.col("lags") + 1)) * F.coalesce(f"g_{k}", F.lit(0.0))).otherwise(0.0)
    return out.select(*keys, "n", "mean", "gamma0", (v / F.col("n")).alias("variance"))


#: Cells (date times pair) whose differences are held at once.
PAIR_CELLS = 1_000_000


def pair_moments(losses: np.ndarray, lags: int) -> Iterator[tuple[int, int, int, float, float, float]]:
    """(i, j, n, mean, gamma0, variance of the mean) of the differences of each pair of columns of (date, model), in
    order of date; a NaN is no loss, and a pair has the dates at which both have one. Bartlett weights up to `lags`."""
    first, second = np.triu_indices(losses.shape[1], 1)
    holes = np.isnan(losses).any(axis=0)

    def moments(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(d)
        e = d - d.mean(axis=0)
        gamma0 = (e * e).mean(axis=0)
        v = gamma0.copy()
        for k in range(1, min(lags, n - 1) + 1):
            v += 2 * (1 - k / (lags + 1)) * (e[k:] * e[:-k]).mean(axis=0)
        return d.mean(axis=0), gamma0, v / n

    whole = np.flatnonzero(~holes[first] & ~holes[second])
    for part in np.array_split(whole, max(1, -(-len(losses) * len(whole) // PAIR_CELLS))):
        if len(part):
            for p, *m in zip(part, *moments(losses[:, first[part]] - losses[:, second[part]]), strict=True):
                yield int(first[p]), int(second[p]), len(losses), *map(float, m)
    for p in np.flatnonzero(holes[first] | holes[second]):
        d = losses[:, first[p]] - losses[:, second[p]]
        d = d[~np.isnan(d)][:, None]
        if len(d):
            yield int(first[p]), int(second[p]), len(d), *(float(m[0]) for m in moments(d))


def dm_moments(loss: DataFrame, lags: int | None = None) -> DataFrame:
    """Per pair of models of a symbol and horizon, the smaller name first: `n`, `mean`, `gamma0`, `variance`.

    The losses are shuffled once, by symbol and horizon; a task lays those of a group side by side, a column for each model, and
    works out all pairs in bounded parts: pairs of rows never meet in a join. Lags default to max(1, h - 1).
    A model has one loss a date; null and NaN losses are left out.
    """
    rows = loss.where("loss is not null and not isnan(loss)").select(*SERIES, "date", F.col("loss").cast("double").alias("loss"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in SERIES}
    schema = f"symbol {kinds['symbol']}, horizon {kinds['horizon']}, model_i {kinds['model']}, model_j {kinds['model']}, n long, mean double, gamma0 double, variance double"

    def run(group: pa.Table) -> pa.Table:
        names = sorted(group.column("model").unique().to_pylist())
        _, date = np.unique(group.column("date").to_numpy(), return_inverse=True)
        column = np.searchsorted(names, group.column("model").to_numpy(zero_copy_only=False).astype(str))
        wide = np.full((date.max() + 1, len(names)), np.nan)
        wide[date, column] = group.column("loss").to_numpy()
        symbol, horizon = group.column("symbol")[0], group.column("horizon")[0]
        made = list(pair_moments(wide, max(1, horizon.as_py() - 1) if lags is None else lags))
        model = group.schema.field("model").type
        columns = [pa.array([x.as_py()] * len(made), x.type) for x in (symbol, horizon)]
        columns += [pa.array([names[m[k]] for m in made], model) for k in (0, 1)] + [pa.array([m[k] for m in made], pa.int64() if k == 2 else pa.float64()) for k in range(2, 6)]
        return pa.Table.from_arrays(columns, names=[*GROUP, "model_i", "model_j", "n", "mean", "gamma0", "variance"])

    return rows.groupBy(*GROUP).applyInArrow(run, schema)


def dm_test(loss: DataFrame, alternative: str = "two-sided", lags: int | None = None) -> DataFrame:
    """Diebold-Mariano test of each pair: `statistic`, `p_value`, `mean_diff`, `n`.

    Lags default to max(1, h - 1), whatever the horizon. A variance that is not positive falls back to
    gamma0 / T; a zero there gives nulls (identical losses).
    """
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError(f"unknown alternative: {alternative}")
    v = dm_moments(loss, lags)
    variance = F.when(F.col("variance") > 0, F.col("variance")).otherwise(F.col("gamma0") / F.col("n"))
    v = v.withColumn("statistic", F.when(variance > 0, F.col("mean") / F.sqrt(variance)))
    t = F.col("statistic")
    p = {"two-sided": two_sided_p(t), "less": normal_cdf(t), "greater": 1 - normal_cdf(t)}[alternative]
    return v.select(*GROUP, "model_i", "model_j", "n", F.col("mean").alias("mean_diff"), "statistic", p.alias("p_value"))


def dm_matrix(loss: DataFrame, **options) -> DataFrame:
    """All ordered pairs of models: symmetric p-values (two-sided) and a diagonal of 1."""
    half = dm_test(loss, **options).select(*GROUP, "model_i", "model_j", "p_value")
    other = half.select(*GROUP, F.col("model_j").alias("model_i"), F.col("model_i").alias("model_j"), "p_value")
    diagonal = loss.select(*GROUP, F.col("model").alias("model_i"), F.col("model").alias("model_j")).distinct().withColumn("p_value", F.lit(1.0))
    return half.unionByName(other).unionByName(diagonal)


def mz_regression(df: DataFrame, lags: Column | int = 22, most_lags: int = 22) -> DataFrame:
    """Mincer-Zarnowitz regression actual ~ 1 + forecast per series, with Bartlett-weighted (HAC) errors.

    `alpha`, `beta`, their errors and p-values against 0 and 1, `r2`, and the joint test as F(2, n - 2).
    A constant forecast gives nulls. Lags that are a column must be bounded by `most_lags`: more raise an error.
    """
    if isinstance(lags, int):
        lags, most_lags = F.lit(lags), max(lags, 1)
    else:
        lags = F.when(lags > most_lags, F.raise_error(F.lit(f"more than {most_lags} lags: give most_lags"))).otherwise(lags)
    df = finite_pairs(df)
    whole = Window.partitionBy(*SERIES)
    w = whole.orderBy("date")
    beta = F.regr_slope("actual", "forecast").over(whole)
    x = df.withColumn("beta", beta).withColumn("mf", F.avg("forecast").over(whole)).withColumn("ma", F.avg("actual").over(whole)).withColumn("lags", lags)
    x = x.withColumn("alpha", F.col("ma") - F.col("beta") * F.col("mf")).withColumn("u", F.col("actual") - F.col("alpha") - F.col("beta") * F.col("forecast"))
    # scores of the constant and of the centred regressor
    x = x.withColumn("s0", F.col("u")).withColumn("s1", F.col("u") * (F.col("forecast") - F.col("mf")))
    sums = []
    for k in range(most_lags + 1):
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            x = x.withColumn(f"q_{k}_{i}{j}", F.col(f"s{i}") * (F.col(f"s{j}") if k == 0 else F.lag(f"s{j}", k).over(w)))
            sums.append(F.coalesce(F.sum(f"q_{k}_{i}{j}"), F.lit(0.0)).alias(f"g_{k}_{i}{j}"))
    g = x.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.first("alpha").alias("alpha"), F.first("beta").alias("beta"), F.first("lags").alias("lags"), F.first("mf").alias("mf"), F.regr_r2("actual", "forecast").alias("r2"), (F.var_pop("forecast") * F.count("*")).alias("sxx"), *sums
    )

    def meat(i: int, j: int) -> Column:
        v = F.col(f"g_0_{i}{j}")
        for k in range(1, most_lags + 1):
            v = v + F.when(F.col("lags") >= k, (1 - k / (F.col("lags") + 1)) * (F.col(f"g_{k}_{i}{j}") + F.col(f"g_{k}_{j}{i}"))).otherwise(0.0)
        return v

    # covariance of (mean level, slope) with the regressor centred, then of (alpha, beta)
    g = g.withColumns({"v00": meat(0, 0) / F.col("n") / F.col("n"), "v01": ratio(meat(0, 1), F.col("n") * F.col("sxx")), "v11": ratio(meat(1, 1), F.col("sxx") * F.col("sxx"))})
    mf = F.col("mf")
    g = g.withColumns({"vaa": F.col("v00") - 2 * mf * F.col("v01") + mf * mf * F.col("v11"), "vab": F.col("v01") - mf * F.col("v11")})
    root = lambda c: F.when(F.col(c) > 0, F.sqrt(c))
    g = g.withColumn("alpha_se", root("vaa")).withColumn("beta_se", root("v11"))
    a, b = F.col("alpha"), F.col("beta") - 1
    det = F.col("vaa") * F.col("v11") - F.col("vab") * F.col("vab")
    wald = ratio(a * a * F.col("v11") - 2 * a * b * F.col("vab") + b * b * F.col("vaa"), det)
    # statistics are columns of their own before their tails repeat them many times
    g = g.withColumns({"t_alpha": ratio(a, F.col("alpha_se")), "t_beta": ratio(b, F.col("beta_se")), "F_stat": wald / 2})
    return g.select(
        *SERIES, "n", "alpha", "alpha_se", two_sided_p(F.col("t_alpha")).alias("alpha_pval"), "beta", "beta_se",
        two_sided_p(F.col("t_beta")).alias("beta_pval"), F.col("r2").alias("R2"), "F_stat", f2_tail(F.col("F_stat"), F.col("n") - 2).alias("F_pval"),
    )


def mz_recursive(df: DataFrame, least: int = 252) -> DataFrame:
    """Corrected forecasts: alpha + beta f_t with the coefficients of all earlier rows, from row `least` on.

    Where the earlier forecasts are constant the forecast stays as it is. Adds `pos` and `corrected`.
    """
    w = Window.partitionBy(*SERIES).orderBy("date")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    slope, level = F.regr_slope("actual", "forecast").over(past), F.regr_intercept("actual", "forecast").over(past)
    corrected = F.when(F.col("pos") >= least, F.coalesce(level + slope * F.col("forecast"), F.col("forecast")))
    return df.withColumn("corrected", corrected)


#: Share of the window, critical values at 10 % and 5 %.
GR_CRITICAL = ((0.1, 3.17, 3.39), (0.2, 2.82, 3.05), (0.3, 2.55, 2.80), (0.4, 2.32, 2.58), (0.5, 2.10, 2.38))


def gr_critical(mu: Column, level: int) -> Column:
    """Critical value by linear interpolation, with the share clipped to the table."""
    c = {10: 1, 5: 2}[level]
    x = F.greatest(F.least(mu, F.lit(GR_CRITICAL[-1][0])), F.lit(GR_CRITICAL[0][0]))
    out = F.lit(GR_CRITICAL[-1][c])
    for lo, hi in reversed(list(zip(GR_CRITICAL, GR_CRITICAL[1:], strict=False))):
        out = F.when(x <= hi[0], lo[c] + (x - lo[0]) * ((hi[c] - lo[c]) / (hi[0] - lo[0]))).otherwise(out)
    return out


def gr_path(diff: DataFrame, keys: Sequence[str], share: float = 0.3, lags: int = 1, least: int = 30) -> DataFrame:
    """Rolling test statistic of the loss difference `d` at the end of each window of m = max(floor(share T), least) rows.

    Windows come from running sums and a self equi-join m rows back, so the cost per row
    does not depend on m. Rows with T < m have no window.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("date")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ks = range(1, lags + 1)
    x = numbered(diff, keys).withColumn("base", F.avg("d").over(whole)).withColumn("e", F.col("d") - F.col("base"))
    x = x.withColumn("m", F.greatest(F.floor(F.col("T") * share), F.lit(least)).cast("long"))
    # running sums of e, of e squared and of products k rows apart
    x = x.withColumns({"cum_e": F.sum("e").over(run), "q_0": F.sum(F.col("e") * F.col("e")).over(run)})
    x = x.withColumns({f"q_{k}": F.sum(F.coalesce(F.col("e") * F.lag("e", k).over(w), F.lit(0.0))).over(run) for k in ks})
    # sums up to k rows before; the same k rows later; and up to row k - 1, for the first window
    x = x.withColumns({f"early_{k}": F.coalesce(F.lag("cum_e", k).over(w), F.lit(0.0)) for k in ks})
    x = x.withColumns({f"f_{k}": F.lead("cum_e", k).over(w) for k in ks} | {f"h_{k}": F.lead(f"q_{k}", k).over(w) for k in ks})
    x = x.withColumns({f"head_{k}": F.max(F.when(F.col("pos") == k - 1, F.col("cum_e"))).over(whole) for k in ks})
    return gr_statistics(x, keys, lags)


def gr_statistics(x: DataFrame, keys: Sequence[str], lags: int) -> DataFrame:
    """The statistics from running sums, their shifts and the first sums `head_k`, by an equi-join m rows back."""
    ks = range(1, lags + 1)
    back = x.select(*keys, (F.col("pos") + F.col("m")).alias("pos"), F.col("cum_e").alias("b_s"), F.col("q_0").alias("b_q_0"), *[F.col(f"{n}_{k}").alias(f"b_{n}_{k}") for n in "fh" for k in ks])
    y = x.where(F.col("pos") >= F.col("m") - 1).join(back, [*keys, "pos"], "left").na.fill(0.0, ["b_s", "b_q_0", *[f"b_h_{k}" for k in ks]])
    m = F.col("m")
    mean = (F.col("cum_e") - F.col("b_s")) / m
    variance = (F.col("q_0") - F.col("b_q_0")) / m - mean * mean
    for k in ks:
        inside = F.col(f"q_{k}") - F.col(f"b_h_{k}")
        late = F.col("cum_e") - F.coalesce(f"b_f_{k}", f"head_{k}")
        early = F.col(f"early_{k}") - F.col("b_s")
        gamma = (inside - mean * (late + early) + (m - k) * mean * mean) / (m - k)
        variance = variance + 2 * (1 - k / (lags + 1.0)) * gamma
    level = mean + F.col("base")
    statistic = F.when(variance > 1e-300, level / F.sqrt(variance / m)).otherwise(0.0)
    return y.select(*keys, "date", "pos", "T", "m", (F.col("pos") - F.col("m") + 1).alias("rel_pos"), statistic.alias("statistic"))


def gr_fluctuation(diff: DataFrame, keys: Sequence[str], share: float = 0.3, lags: int = 1) -> DataFrame:
    """Largest absolute rolling statistic and the decisions at 10 % and 5 %."""
    return gr_decisions(gr_path(diff, keys, share, lags), keys)


def gr_decisions(path: DataFrame, keys: Sequence[str]) -> DataFrame:
    sup = path.groupBy(*keys).agg(F.first("T").alias("T"), F.first("m").alias("m"), F.max(F.abs("statistic")).alias("sup_stat"))
    mu = F.col("m") / F.col("T")
    sup = sup.withColumn("cv_10", gr_critical(mu, 10)).withColumn("cv_5", gr_critical(mu, 5))
    return sup.withColumn("reject_10", F.col("sup_stat") > F.col("cv_10")).withColumn("reject_5", F.col("sup_stat") > F.col("cv_5"))


def against_benchmark(loss: DataFrame, benchmark: str) -> DataFrame:
    """Loss of the benchmark minus the model's, for every other model."""
    base = loss.where(F.col("model") == benchmark).select(*GROUP, "date", F.col("loss").alias("base"))
    return loss.where(F.col("model") != benchmark).join(base, [*GROUP, "date"]).select(*SERIES, "date", (F.col("base") - F.col("loss")).alias("d"))


def gr_multiple(df: DataFrame, benchmark: str, kind: str = "QLIKE", share: float = 0.3, lags: int = 1) -> DataFrame:
    return gr_fluctuation(against_benchmark(losses(df, kind), benchmark), SERIES, share, lags)
