"""Walk-forward and expanding regressions: folds, grouped least squares, forecasts.

The fit of a fold is a grouped aggregate: means and covariances of the regressors and
the target, combined before the shuffle. The normal equations (at most seven
unknowns) are solved by a Cholesky factorisation written as column expressions, so
nothing leaves the JVM, and a thousand symbols and folds cost one aggregation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspan.functions.numeric import clip_low, ratio, two_sided_p
from volspan.operators.features import REGRESSORS, features_for_model
from volspan.session import new_path

#: Least pivot of the scaled matrix; below it the fit is null.
PIVOT = 1e-12


def walk_forward_folds(df: DataFrame, train: int = 252, test: int = 126, step: int = 126) -> DataFrame:
    """Folds of each symbol by position: train [f step, f step + train), test from there up to `test` rows or the end."""
    n = df.groupBy("symbol").agg(F.count("*").alias("n"))
    folds = n.where(F.col("n") > train).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - train - 1) / step))))
    start = F.col("fold") * step
    return folds.select("symbol", "fold", start.alias("train_start"), (start + train).alias("train_end"), (start + train).alias("test_start"), F.least(start + train + test, F.col("n")).alias("test_end"))


def train_rows(df: DataFrame, train: int, step: int) -> DataFrame:
    """Each row once for every fold that trains on it (at most ceil(train / step) times)."""
    pos = F.col("pos")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((pos - train + 1) / step))
    last = F.floor(pos / step)
    return df.withColumn("fold", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def test_rows(df: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """Each row for the first fold that tests on it."""
    pos = F.col("pos")
    # the first fold f with f step + train <= pos < f step + train + test
    first = F.greatest(F.lit(0).cast("long"), F.floor((pos - train - test) / step) + 1)
    return df.where(pos >= train).withColumn("fold", first).where(F.col("fold") * step + train <= pos)


#: Eigenvalues of the correlation matrix below this share of the largest count as 0.
RANK_SHARE = 1e-10


def least_norm(n: float, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, float | None]:
    """Of all least-squares solutions the one with the smallest sum of squared coefficients, the constant's among them, and `sigma2`.

    `mean` and `cov` are of the regressors and then the target.
    """
    k = len(mean) - 1
    scale = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
    scale = np.where(scale > 1e-12 * np.maximum(np.abs(mean[:k]), 1e-300), scale, 0.0)
    safe = np.where(scale > 0, scale, 1.0)
    r = np.where(np.outer(scale, scale) > 0, cov[:k, :k] / np.outer(safe, safe), 0.0)
    values, vectors = np.linalg.eigh(r)
    kept = values > RANK_SHARE * max(values.max(initial=0.0), 1e-300)
    to_y = np.where(scale > 0, cov[:k, k] / safe, 0.0)
    b = vectors[:, kept] @ ((vectors[:, kept].T @ to_y) / values[kept]) / safe
    free = vectors[:, ~kept] / safe[:, None]  # what may be added without another fit
    if free.shape[1]:
        a = np.vstack([-mean[:k] @ free, free])
        b = b - free @ np.linalg.lstsq(a, np.concatenate([[mean[k] - mean[:k] @ b], b]), rcond=None)[0]
    rank = int(kept.sum()) + 1
    left = max(0.0, float(cov[k, k] - b @ cov[:k, k]))
    return np.concatenate([[mean[k] - mean[:k] @ b], b]), n * left / (n - rank) if n > rank else None


def fill_least_norm(fit: DataFrame, keys: Sequence[str], x: Sequence[str], y: str) -> DataFrame:
    """The groups without a fit get the one of least norm, from their moments."""
    columns = [*x, y]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    kept = [*keys, "n_obs", "const", *[f"b_{c}" for c in x], "sigma2", "r2"]
    moments = [f"m_{c}" for c in columns] + [f"c_{columns[i]}_{columns[j]}" for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if row["const"] is None and row["n_obs"]:
                    cov = np.zeros((len(columns), len(columns)))
                    for i, j in pairs:
                        cov[i, j] = cov[j, i] = row[f"c_{columns[i]}_{columns[j]}"]
                    b, row["sigma2"] = least_norm(row["n_obs"], np.array([row[f"m_{c}"] for c in columns]), cov)
                    row["const"] = float(b[0])
                    row |= {f"b_{c}": float(v) for c, v in zip(x, b[1:], strict=True)}
                    spread = cov[-1, -1]
                    row["r2"] = float(b[1:] @ cov[:-1, -1] / spread) if spread > 0 else None
            yield pa.RecordBatch.from_pylist([{c: row[c] for c in kept} for row in rows], schema=pa.schema([batch.schema.field(c) for c in kept]))

    schema = ", ".join(f"`{c}` {fit.schema[c].dataType.simpleString()}" for c in kept)
    return fit.select(*kept, *moments).mapInArrow(run, schema)


def ols_fit(df: DataFrame, keys: Sequence[str], x: Sequence[str], y: str = "y", minimum_norm: bool = False) -> DataFrame:
    """Least squares with a constant per group: `n_obs`, `const`, `b_<x>`, `sigma2` (SSR / (n - k)) and `r2`.

    Groups whose regressors are collinear, or that have fewer rows than unknowns, get nulls, or with `minimum_norm` the
    solution of least norm (that of a pseudo-inverse), worked out from their moments by one Arrow pass over the fits.
    """
    columns = [*x, y]
    moments = {f"m_{c}": F.avg(c) for c in columns}
    for i, a in enumerate(columns):
        for b in columns[i:]:
            moments[f"c_{a}_{b}"] = F.covar_pop(a, b)
    fit = df.groupBy(*keys).agg(F.count("*").alias("n_obs"), *[e.alias(n) for n, e in moments.items()])
    cov = lambda a, b: F.col(f"c_{a}_{b}" if f"c_{a}_{b}" in moments else f"c_{b}_{a}")
    k = len(x)
    fit = fit.withColumns({f"s_{c}": F.when(cov(c, c) > 0, F.sqrt(cov(c, c))) for c in x})
    fit = fit.withColumns({f"r_{i}_{j}": cov(x[i], x[j]) / (F.col(f"s_{x[i]}") * F.col(f"s_{x[j]}")) for i in range(k) for j in range(i + 1)} | {f"r_{i}_y": cov(x[i], y) / F.col(f"s_{x[i]}") for i in range(k)})
    for j in range(k):  # column j of the factor, then its entry of the forward solution
        pivot = F.col(f"r_{j}_{j}")
        for t in range(j):
            pivot = pivot - F.col(f"l_{j}_{t}") * F.col(f"l_{j}_{t}")
        fit = fit.withColumn(f"l_{j}_{j}", F.when(pivot > PIVOT, F.sqrt(pivot)))
        entries = {}
        for i in range(j + 1, k):
            v = F.col(f"r_{i}_{j}")
            for t in range(j):
                v = v - F.col(f"l_{i}_{t}") * F.col(f"l_{j}_{t}")
            entries[f"l_{i}_{j}"] = v / F.col(f"l_{j}_{j}")
        v = F.col(f"r_{j}_y")
        for t in range(j):
            v = v - F.col(f"l_{j}_{t}") * F.col(f"z_{t}")
        entries[f"z_{j}"] = v / F.col(f"l_{j}_{j}")
        fit = fit.withColumns(entries)
    for j in range(k - 1, -1, -1):
        v = F.col(f"z_{j}")
        for t in range(j + 1, k):
            v = v - F.col(f"l_{t}_{j}") * F.col(f"w_{t}")
        fit = fit.withColumn(f"w_{j}", v / F.col(f"l_{j}_{j}"))
    fit = fit.withColumns({f"b_{x[j]}": F.col(f"w_{j}") / F.col(f"s_{x[j]}") for j in range(k)})
    explained, const = F.lit(0.0), F.col(f"m_{y}")
    for c in x:
        explained = explained + F.col(f"b_{c}") * cov(c, y)
        const = const - F.col(f"b_{c}") * F.col(f"m_{c}")
    n = F.col("n_obs")
    enough = n > k + 1
    ssr = n * F.greatest(cov(y, y) - explained, F.lit(0.0))
    out = [F.when(n >= k + 1, const).alias("const"), *[F.when(n >= k + 1, F.col(f"b_{c}")).alias(f"b_{c}") for c in x]]
    out = [*keys, "n_obs", *out, F.when(enough, ssr / (n - k - 1)).alias("sigma2"), ratio(explained, cov(y, y)).alias("r2")]
    return fill_least_norm(fit.select(*out, *moments), keys, x, y) if minimum_norm else fit.select(*out)


def ols_summary(df: DataFrame, keys: Sequence[str], x: Sequence[str], lags: int = 22, y: str = "y") -> DataFrame:
    """One row per coefficient: estimate, error, t and p, with Bartlett-weighted (HAC) errors, and the fit's R2.

    A coefficient is a weighted sum of the residuals beside its true value: the weight of a row is what the
    other regressors leave of this one, over the sum of its squares. The error is the
    long-run variance of weight times residual, so each one is an aggregate of lag products.
    """
    keys = list(keys)
    rows = ols_predict(df, ols_fit(df, keys, x, y), keys, x, "fit").withColumn("u", F.col(y) - F.col("fit"))
    terms = []
    for c in x:
        others = [o for o in x if o != c]
        own = ols_fit(df, keys, others, c).select(*keys, F.col("const").alias(f"c_{c}"), *[F.col(f"b_{o}").alias(f"c_{c}_{o}") for o in others])
        left = F.col(c) - F.col(f"c_{c}")
        for o in others:
            left = left - F.col(f"c_{c}_{o}") * F.col(o)
        rows = rows.join(own, keys).withColumn(f"left_{c}", left)
    whole = Window.partitionBy(*keys)
    rows = rows.withColumns({f"a_{c}": ratio(F.col(f"left_{c}"), F.sum(F.col(f"left_{c}") * F.col(f"left_{c}")).over(whole)) for c in x})
    level = ratio(F.lit(1.0), F.count("*").over(whole).cast("double"))
    for c in x:
        level = level - F.avg(c).over(whole) * F.col(f"a_{c}")
    rows = rows.withColumn("a_const", level)
    for term in ("const", *x):
        estimate = F.col("const" if term == "const" else f"b_{term}")
        terms.append(F.struct(F.lit(term).alias("term"), estimate.alias("estimate"), (F.col(f"a_{term}") * F.col("u")).alias("s")))
    long = rows.select(*keys, "date", "r2", F.explode(F.array(*terms)).alias("x")).select(*keys, "date", "r2", "x.*")
    w = Window.partitionBy(*keys, "term").orderBy("date")
    long = long.withColumns({f"q_{k}": F.col("s") * F.lag("s", k).over(w) for k in range(1, lags + 1)})
    sums = {k: F.coalesce(F.sum(f"q_{k}"), F.lit(0.0)) for k in range(1, lags + 1)}
    variance = F.sum(F.col("s") * F.col("s"))
    for k, v in sums.items():
        variance = variance + 2 * (1 - k / (lags + 1)) * v
    out = long.groupBy(*keys, "term").agg(F.first("estimate").alias("estimate"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("se"), F.first("r2").alias("R2"), F.count("*").alias("n"))
    t = ratio(F.col("estimate"), F.col("se"))
    return out.withColumn("t", t).withColumn("p_value", two_sided_p(F.col("t")))


def ols_residuals(df: DataFrame, keys: Sequence[str], x: Sequence[str], y: str = "y", minimum_norm: bool = False) -> DataFrame:
    """The rows of `df` that have a fit, with `fit` and `residual`."""
    out = ols_predict(df, ols_fit(df, keys, x, y, minimum_norm), keys, x, "fit")
    return out.select(*df.columns, "fit", (F.col(y) - F.col("fit")).alias("residual"))


def ols_predict(rows: DataFrame, fit: DataFrame, keys: Sequence[str], x: Sequence[str], name: str = "forecast") -> DataFrame:
    """The fitted value of each row; rows without a fit go."""
    value = F.col("const")
    for c in x:
        value = value + F.col(f"b_{c}") * F.col(c)
    return rows.join(fit, list(keys)).withColumn(name, value)


def floor_forecast(x: Column, low: float = 1e-6) -> Column:
    return clip_low(x, low)


def walk_forward(df: DataFrame, model: str = "HAR", horizon: int = 1, train: int = 252, test: int = 126, step: int = 126, floor: float | None = 1e-6, purge: bool = False, minimum_norm: bool = False) -> DataFrame:
    """Out-of-sample forecasts of a regression model on a preprocessed panel: symbol, date, fold, actual, forecast.

    One fit per fold: daily refits on the same training rows would give the same
    coefficients. On dates that several folds test, the first fold wins. Training targets
    of longer horizons reach into the test block unless `purge` drops them.
    """
    x = REGRESSORS[model]
    rows = features_for_model(df, model, horizon)
    training = train_rows(rows, train, step)
    if purge and horizon > 1:
        training = training.where(F.col("pos") <= F.col("fold") * step + train - horizon)
    fit = ols_fit(training, ["symbol", "fold"], x, minimum_norm=minimum_norm)
    out = ols_predict(test_rows(rows, train, test, step), fit, ["symbol", "fold"], x)
    if model == "Log_HAR":
        out = out.withColumn("forecast", F.exp(F.col("forecast") + F.col("sigma2") / 2))
    if floor is not None:
        out = out.withColumn("forecast", floor_forecast(F.col("forecast"), floor))
    return out.select("symbol", "date", "fold", "actual", "forecast")


def centred_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds `mean_<c>` of the symbol and `d_<c>`, the value less it."""
    rows = rows.withColumns({f"mean_{c}": F.avg(c).over(Window.partitionBy("symbol")) for c in columns})
    return rows.withColumns({f"d_{c}": F.col(c) - F.col(f"mean_{c}") for c in columns})


def window_sums(rows: DataFrame, windows: Callable[[DataFrame], DataFrame], start: Column, end: Column, crossed: Column, x: Sequence[str], y: str = "y") -> DataFrame:
    """The sums of `solve_sums` over windows of rows: for each row of `windows` (symbol, ...), made from the symbols and their numbers of rows `n`.

    `crossed` counts, for a row, the starts and ends of windows up to its position; `start` and `end` are those counts at the
    first row of a window and at the first one behind it. Rows between two neighbouring ones are a block, blocks are summed
    once, and a window is the difference of two running sums of blocks. No row is copied for the windows that
    hold it. Rows are those of `centred_rows`. Windows that end behind the last row are left out.
    """
    columns = [*x, y]
    sums = {f"s_{c}": F.sum(f"d_{c}") for c in columns} | {f"s_{a}_{b}": F.sum(F.col(f"d_{a}") * F.col(f"d_{b}")) for i, a in enumerate(columns) for b in columns[i:]}
    names = ["rows", *sums]
    blocks = rows.groupBy("symbol", crossed.alias("block")).agg(F.count("*").alias("rows"), *[e.alias(n) for n, e in sums.items()])
    before = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = blocks.select("symbol", "block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names], F.sum("rows").over(Window.partitionBy("symbol")).alias("all rows"))
    # a few rows per fold, read three times: written once
    path = new_path(rows.sparkSession, "block_sums")
    upto.write.parquet(path)
    upto = rows.sparkSession.read.schema(upto.schema).parquet(path)
    wanted = windows(upto.groupBy("symbol").agg(F.max("all rows").alias("n")))
    found = wanted.withColumns({"first block": start, "end block": end})
    for side in ("first", "end"):
        own = upto.select("symbol", F.col("block").alias(f"{side} block"), *[F.col(n).alias(f"{side} {n}") for n in names])
        found = found.join(own, ["symbol", f"{side} block"])
    return found.select(*wanted.columns, *[(F.col(f"end {n}") - F.col(f"first {n}")).alias(n) for n in names])


def refit_walk_forward(df: DataFrame, model: str = "HAR", horizon: int = 1, train: int = 252, test: int = 126, step: int = 126, every: int = 22) -> DataFrame:
    """As `walk_forward`, but refitted every `every` test rows on the window and the test rows before.

    The windows of all folds and refits are differences of running sums of blocks (`window_sums`).
    """
    x = REGRESSORS[model]
    rows = centred_rows(features_for_model(df, model, horizon), [*x, "y"])
    refits = -(-test // every)
    tested = test_rows(rows, train, test, step).withColumn("refit", F.floor((F.col("pos") - F.col("fold") * step - train) / every))

    def origins(n: DataFrame) -> DataFrame:
        """Every fold and refit with rows to test."""
        folds = n.where(F.col("n") > train).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - train - 1) / step))))
        spread = folds.withColumn("refit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(refits - 1).cast("long"))))
        return spread.where(F.col("fold") * step + train + F.col("refit") * every < F.col("n")).drop("n")

    def crossed(pos: Column) -> Column:
        """Starts and origins at or before a position."""
        out = F.floor(pos / step) + 1
        for r in range(refits):
            out = out + F.greatest(F.floor((pos - train - r * every) / step) + 1, F.lit(0))
        return out

    start = F.col("fold") * step
    sums = window_sums(rows, origins, crossed(start), crossed(start + train + F.col("refit") * every), crossed(F.col("pos")), x)
    fit = solve_sums(sums, ["symbol", "fold", "refit"], x, variance=model == "Log_HAR")
    out = tested.join(fit, ["symbol", "fold", "refit"])
    value = F.col("const") + F.col("mean_y")
    for c in x:
        value = value + F.col(f"b_{c}") * F.col(f"d_{c}")
    out = out.withColumn("forecast", F.exp(value + F.col("sigma2") / 2) if model == "Log_HAR" else value)
    return out.select("symbol", "date", "fold", "refit", "actual", "forecast")


def expanding_forecast(df: DataFrame, oos_start, model: str = "HAR", horizon: int = 1, least: int = 500, every: int = 22) -> DataFrame:
    """From `oos_start` on: fit on all earlier rows, at least `least`, every `every` rows.

    Moments grow with the window: each refit block's sums are taken once and
    accumulated over the blocks, so a long history is not fitted again and again.
    """
    x = REGRESSORS[model]
    rows = features_for_model(df, model, horizon)
    w = Window.partitionBy("symbol").orderBy("date")
    start = F.to_date(F.lit(oos_start))
    rows = rows.withColumn("oos", (F.col("date") >= start) & (F.col("pos") >= least))
    rows = rows.withColumn("oos_pos", F.sum(F.col("oos").cast("long")).over(w) - 1)
    rows = rows.withColumn("refit", F.when(F.col("oos"), F.floor(F.col("oos_pos") / every)))
    columns = [*x, "y"]
    shift = {c: F.avg(F.when(~F.col("oos"), F.col(c))).over(Window.partitionBy("symbol")) for c in columns}
    centred = rows.withColumns({f"d_{c}": F.col(c) - e for c, e in shift.items()})
    block = F.coalesce("refit", F.lit(-1))
    sums = {f"s_{c}": F.sum(f"d_{c}") for c in columns} | {f"s_{a}_{b}": F.sum(F.col(f"d_{a}") * F.col(f"d_{b}")) for i, a in enumerate(columns) for b in columns[i:]}
    blocks = centred.groupBy("symbol", block.alias("block")).agg(F.count("*").alias("rows"), *[e.alias(n) for n, e in sums.items()])
    before = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    grown = blocks.select("symbol", F.col("block").alias("refit"), *[F.sum(n).over(before).alias(n) for n in ("rows", *sums)]).where("refit >= 0 and rows is not null")
    fit = solve_sums(grown, ["symbol", "refit"], x)
    out = centred.where("oos").join(fit, ["symbol", "refit"])
    value = F.col("const")
    for c in x:
        value = value + F.col(f"b_{c}") * F.col(f"d_{c}")
    return out.select("symbol", "date", "refit", "actual", (value + F.col("y") - F.col("d_y")).alias("forecast"))


def solve_sums(sums: DataFrame, keys: Sequence[str], x: Sequence[str], y: str = "y", variance: bool = False) -> DataFrame:
    """Coefficients, and with `variance` also `sigma2`, from sums `rows`, `s_<a>` and `s_<a>_<b>` of shifted columns; the constant is for shifted values."""
    n = F.col("rows")
    k = len(x)
    cov = lambda a, b: F.col(f"s_{a}_{b}") / n - F.col(f"s_{a}") * F.col(f"s_{b}") / n / n
    fit = sums
    fit = fit.withColumns({f"c_{i}_{j}": cov(x[j], x[i]) for i in range(k) for j in range(i + 1)} | {f"c_{i}_y": cov(x[i], y) for i in range(k)})
    fit = fit.withColumns({f"sd_{i}": F.when(F.col(f"c_{i}_{i}") > 0, F.sqrt(f"c_{i}_{i}")) for i in range(k)})
    for j in range(k):
        pivot = F.lit(1.0)
        for t in range(j):
            pivot = pivot - F.col(f"l_{j}_{t}") * F.col(f"l_{j}_{t}")
        fit = fit.withColumn(f"l_{j}_{j}", F.when((pivot > PIVOT) & F.col(f"sd_{j}").isNotNull(), F.sqrt(pivot)))
        entries = {}
        for i in range(j + 1, k):
            v = F.col(f"c_{i}_{j}") / (F.col(f"sd_{i}") * F.col(f"sd_{j}"))
            for t in range(j):
                v = v - F.col(f"l_{i}_{t}") * F.col(f"l_{j}_{t}")
            entries[f"l_{i}_{j}"] = v / F.col(f"l_{j}_{j}")
        v = F.col(f"c_{j}_y") / F.col(f"sd_{j}")
        for t in range(j):
            v = v - F.col(f"l_{j}_{t}") * F.col(f"z_{t}")
        entries[f"z_{j}"] = v / F.col(f"l_{j}_{j}")
        fit = fit.withColumns(entries)
    for j in range(k - 1, -1, -1):
        v = F.col(f"z_{j}")
        for t in range(j + 1, k):
            v = v - F.col(f"l_{t}_{j}") * F.col(f"w_{t}")
        fit = fit.withColumn(f"w_{j}", v / F.col(f"l_{j}_{j}"))
    fit = fit.withColumns({f"b_{x[j]}": F.col(f"w_{j}") / F.col(f"sd_{j}") for j in range(k)})
    const = F.col(f"s_{y}") / n
    for c in x:
        const = const - F.col(f"b_{c}") * F.col(f"s_{c}") / n
    if not variance:
        return fit.select(*keys, "rows", const.alias("const"), *[f"b_{c}" for c in x])
    left = cov(y, y)
    for i, c in enumerate(x):
        left = left - F.col(f"b_{c}") * F.col(f"c_{i}_y")
    sigma2 = F.when(n > k + 1, n * F.greatest(left, F.lit(0.0)) / (n - k - 1))
    return fit.select(*keys, "rows", const.alias("const"), *[f"b_{c}" for c in x], sigma2.alias("sigma2"))
