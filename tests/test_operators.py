"""Hand-made series with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspan.functions import losses as L
from volspan.functions.numeric import f2_tail, normal_cdf, t_two_sided_p
from volspan.operators import arma, compare, context, features, mcs, reports, walk
from volspan.sources import forecasts as io
from volspan.sources import panel as panels
from volspan.sources.ticks import realized_measures

DAY = dt.date(2020, 1, 1)


def series(spark, values, symbol="S", **more):
    rows = [(symbol, DAY + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, date date, rv double")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def forecasts(spark, actual, model_forecasts, horizon=1):
    rows = [("S", horizon, m, DAY + dt.timedelta(days=i), float(a), float(f)) for m, fs in model_forecasts.items() for i, (a, f) in enumerate(zip(actual, fs, strict=True))]
    return spark.createDataFrame(rows, "symbol string, horizon int, model string, date date, actual double, forecast double")


@pytest.mark.parametrize(("n", "folds"), [(10, 0), (11, 1), (15, 1), (16, 2), (21, 3)])
def test_fold_edges(spark, n, folds):
    got = walk.walk_forward_folds(series(spark, range(1, n + 1)), 10, 5, 5).orderBy("fold").collect()
    expected = [(f, f * 5, f * 5 + 10, min(f * 5 + 15, n)) for f in range(folds)]
    assert [(r.fold, r.train_start, r.train_end, r.test_end) for r in got] == expected


def test_first_fold_wins_when_tests_overlap(spark):
    df = series(spark, range(1, 31)).withColumn("pos", features.position())
    got = {r.pos: r.fold for r in walk.test_rows(df, 10, 6, 3).collect()}
    for pos in range(10, 30):
        assert got[pos] == next(f for f in range(100) if f * 3 + 10 <= pos < f * 3 + 16)


def test_train_rows_cover_each_window(spark):
    df = series(spark, range(1, 31)).withColumn("pos", features.position())
    got = {}
    for r in walk.train_rows(df, 10, 4).collect():
        got.setdefault(r.fold, set()).add(r.pos)
    for f in range(6):
        assert got[f] == {p for p in range(f * 4, f * 4 + 10) if p < 30}


def test_gaps_and_incomplete_means(spark):
    df = panels.observed(series(spark, [1, 2, None, 4, float("nan"), 6, 7]), "rv")
    out = df.select("rv", features.rolling_mean("rv", 3).alias("m"), features.target("rv", 3).alias("t"), context.context_target(3).alias("c")).collect()
    assert [r.rv for r in out] == [1, 2, 4, 6, 7]
    assert [r.m for r in out] == [None, None, 7 / 3, 4, 17 / 3]
    assert [r.t for r in out] == [7 / 3, 4, 17 / 3, None, None]
    assert [r.c for r in out] == [7 / 3, 4, 17 / 3, 6.5, 7]


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)) * [1e-4, 1.0, 50.0] + [2e-4, 3.0, -7.0]
    y = 0.3 + x @ [1000.0, -2.0, 0.1] + rng.normal(size=60)
    rows = [("g", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    fit = walk.ols_fit(spark.createDataFrame(rows, "g string, a double, b double, c double, y double"), ["g"], ["a", "b", "c"]).first()
    beta, ssr, *_ = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)
    assert np.allclose([fit.const, fit.b_a, fit.b_b, fit.b_c], beta, rtol=1e-8)
    assert math.isclose(fit.sigma2, ssr[0] / 56, rel_tol=1e-9)


def test_collinear_group_is_null(spark):
    rows = [("g", float(i), 2.0 * i, float(i % 3)) for i in range(10)]
    fit = walk.ols_fit(spark.createDataFrame(rows, "g string, a double, b double, y double"), ["g"], ["a", "b"]).first()
    assert fit.b_a is None and fit.const is None


def test_hac_summary_against_numpy(spark):
    rng = np.random.default_rng(1)
    n, lags = 80, 5
    x = rng.normal(size=(n, 2)) + 3
    u = rng.normal(size=n)
    y = 1 + x @ [0.5, -1.0] + u
    rows = [("g", DAY + dt.timedelta(days=i), *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, date date, a double, b double, y double")
    got = {r.term: r for r in walk.ols_summary(df, ["g"], ["a", "b"], lags).collect()}
    xx = np.column_stack([np.ones(n), x])
    beta = np.linalg.lstsq(xx, y, rcond=None)[0]
    s = xx * (y - xx @ beta)[:, None]
    meat = s.T @ s
    for k in range(1, lags + 1):
        g = s[k:].T @ s[:-k]
        meat += (1 - k / (lags + 1)) * (g + g.T)
    bread = np.linalg.inv(xx.T @ xx)
    se = np.sqrt(np.diag(bread @ meat @ bread))
    assert np.allclose([got[t].estimate for t in ("const", "a", "b")], beta)
    assert np.allclose([got[t].se for t in ("const", "a", "b")], se)


def test_losses(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (-1.0, 1.0), (1.0, 0.0)], "actual double, forecast double")
    r = df.agg(L.mse().alias("mse"), L.mae().alias("mae"), L.qlike().alias("qlike")).first()
    assert r.mse == (1 + 0 + 4 + 1) / 4 and r.mae == 1.0
    assert math.isclose(r.qlike, (0.5 - math.log(0.5) - 1) / 2)
    assert df.select(L.loss_series().alias("x")).where("x is null").count() == 0
    same = spark.createDataFrame([(1.0, 2.0)] * 3, "actual double, forecast double")
    assert same.agg(L.r2_oos().alias("r")).first().r == 0.0


def test_normal_and_f_tails(spark):
    xs = [-40.0, -8.5, -3.0, -1.0, 0.0, 0.5, 2.0, 6.0, 7.5]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").select(normal_cdf(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rtol=1e-7, atol=1e-15)
    assert math.isclose(spark.range(1).select(f2_tail(F.lit(3.0), F.lit(10)).alias("p")).first().p, (1 + 0.6) ** -5)


def test_dm_identical_losses_and_symmetry(spark):
    rng = np.random.default_rng(2)
    a = rng.gamma(2, 1, 60)
    df = forecasts(spark, a, {"A": a * 1.1, "B": a * 0.7 + 0.1, "C": a * 1.1})
    m = {(r.model_i, r.model_j): r.p_value for r in compare.dm_matrix(compare.losses(df)).collect()}
    assert m["A", "C"] is None and m["A", "A"] == 1.0 and m["A", "B"] == m["B", "A"]
    d = L_series(a, a * 1.1) - L_series(a, a * 0.7 + 0.1)
    e = d - d.mean()
    v = ((e * e).mean() + 2 * 0.5 * (e[1:] * e[:-1]).mean()) / 60
    v = v if v > 0 else (e * e).mean() / 60
    t = {r.model_j: r.statistic for r in compare.dm_test(compare.losses(df)).where("model_i = 'A'").collect()}
    assert math.isclose(t["B"], d.mean() / math.sqrt(v), rel_tol=1e-9)


def L_series(a, f):
    r = np.maximum(a / np.maximum(f, 1e-10), 1e-10)
    return r - np.log(r) - 1


@pytest.mark.parametrize(("n", "lags"), [(30, 1), (99, 1), (140, 3)])
def test_gr_path_against_windows(spark, n, lags):
    rng = np.random.default_rng(n)
    d = rng.normal(size=n) + 0.2
    df = spark.createDataFrame([("S", DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(d)], "symbol string, date date, d double")
    got = [r.statistic for r in compare.gr_path(df, ["symbol"], 0.3, lags).orderBy("pos").collect()]
    m = max(int(0.3 * n), 30)
    expected = []
    for t in range(m, n + 1):
        w = d[t - m : t]
        e = w - w.mean()
        v = (e * e).mean() + sum(2 * (1 - k / (lags + 1)) * (e[k:] * e[:-k]).mean() for k in range(1, lags + 1))
        expected.append(w.mean() / math.sqrt(v / m) if v > 0 else 0.0)
    assert np.allclose(got, expected, rtol=1e-8)


def test_constant_forecast_in_mz(spark):
    a = np.arange(1, 21) / 10
    df = forecasts(spark, a, {"flat": np.full(20, 0.5)})
    assert compare.mz_regression(df, 2, 2).first().beta is None
    got = compare.mz_recursive(df, 5).where("pos >= 5").collect()
    assert all(r.corrected == 0.5 for r in got) and len(got) == 15


def test_mcs_drops_the_dominated_model(spark):
    rng = np.random.default_rng(3)
    rows = [("S", 1, m, DAY + dt.timedelta(days=i), float(abs(rng.normal()) + shift)) for m, shift in (("good", 0.0), ("fair", 0.01), ("bad", 3.0)) for i in range(120)]
    loss = spark.createDataFrame(rows, "symbol string, horizon int, model string, date date, loss double")
    got = {r.model: r for r in mcs.mcs(loss, replicates=60, block=10).collect()}
    assert got["good"].in_mcs and got["fair"].in_mcs and not got["bad"].in_mcs
    assert got["bad"].mcs_pvalue < 0.1 <= got["good"].mcs_pvalue


def test_ranks_ties_and_flags(spark):
    t = spark.createDataFrame([("a", 1, 1.0, 1.0, 2.0, 0.1), ("b", 1, 1.0, 2.0, 0.5, 0.3), ("c", 1, 2.0, 3.0, 0.5, 0.2)], "model string, horizon int, MSE double, MAE double, QLIKE double, R2OOS double")
    order = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "model string, ord int")
    got = {r.model: r for r in reports.flag_best(t, order).collect()}
    assert got["b"].best_MSE and not got["a"].best_MSE and got["c"].best_QLIKE and got["b"].best_R2OOS and got["a"].dagger
    ranks = {r.model: r.r for r in t.select("model", reports.average_rank("MSE", ["horizon"]).alias("r")).collect()}
    assert ranks == {"a": 1.5, "b": 1.5, "c": 3.0}


def test_memory_and_fractional_difference(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    df = series(spark, x).withColumnRenamed("rv", "log_rv")
    n, e = 400, x - x.mean()
    j = np.arange(1, 21)
    z = np.exp(-2j * np.pi * np.outer(j, np.arange(n)) / n) @ e
    lx = -2 * np.log(2 * np.sin(np.pi * j / n))
    slope = np.polyfit(lx, np.log(abs(z) ** 2 / (2 * np.pi * n)), 1)[0]
    assert math.isclose(arma.gph_d(df).first().d, np.clip(slope, -0.49, 0.49), rel_tol=1e-6)
    got = [r.fracdiff for r in arma.fracdiff(df, 0.3, 50).orderBy("date").collect()]
    w = np.array(arma.fracdiff_weights(0.3, 50))
    assert np.allclose(got, [w @ x[t - 50 : t + 1][::-1] for t in range(50, 400)])


def test_arma_recovers_an_autoregression(spark):
    rng = np.random.default_rng(5)
    y = [0.0]
    for _ in range(420):
        y.append(0.7 * y[-1] + 0.2 * rng.normal())
    out = arma.arma_walk_forward(series(spark, np.exp(np.array(y) - 8)), train=252, test=126, step=126, p=1, q=1).orderBy("date").collect()
    assert len(out) == 421 - 252
    assert np.corrcoef([math.log(r.forecast) for r in out], [math.log(r.actual) for r in out])[0, 1] > 0
    per_refit = {}
    for r in out:
        per_refit.setdefault((r.fold, r.refit), set()).add(r.forecast)
    assert all(len(v) == 1 for v in per_refit.values())


def test_arma_two_stages_against_numpy(spark):
    rng = np.random.default_rng(6)
    rv = np.exp(rng.normal(size=160) * 0.5 - 8)
    train, test, every, long_ar = 100, 40, 15, 3
    got = {(r.fold, r.refit): r.forecast for r in arma.arma_walk_forward(series(spark, rv), train=train, test=test, step=test, every=every, p=2, q=2, long_ar=long_ar).collect()}
    y = np.log(rv)

    def fit(x, t):
        x = np.column_stack([np.ones(len(x)), x])
        beta, ssr, *_ = np.linalg.lstsq(x, t, rcond=None)
        return beta, float(((t - x @ beta) ** 2).sum()) / (len(t) - x.shape[1])

    assert set(got) == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)}
    for (fold, refit), value in got.items():
        z = y[fold * test : fold * test + train + refit * every]
        lags = np.column_stack([z[long_ar - k : len(z) - k] for k in range(1, long_ar + 1)])
        a, _ = fit(lags, z[long_ar:])
        e = z[long_ar:] - np.column_stack([np.ones(len(lags)), lags]) @ a
        zz = z[long_ar:]
        x = np.column_stack([zz[1:-1], zz[:-2], e[1:-1], e[:-2]])
        b, s2 = fit(x, zz[2:])
        assert math.isclose(value, math.exp(b @ [1, zz[-1], zz[-2], e[-1], e[-2]] + s2 / 2), rel_tol=1e-7)


def test_names(spark):
    names = ["HAR_RS_C_h1", "HAR_C_h22", "HAR_C_h1_ctx128", "x", "roll_5_EURUSD_h5"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.model, r.symbol, r.horizon) for r in io.parse_forecast_name(df).collect()}
    assert got == {"HAR_RS_C_h1": ("HAR_RS", "C", 1), "HAR_C_h22": ("HAR", "C", 22), "roll_5_EURUSD_h5": ("roll_5", "EURUSD", 5)}
    assets = spark.createDataFrame([("C",), ("RS_C",), ("EURUSD",)], "symbol string")
    got = {r.name: (r.model, r.symbol) for r in io.parse_forecast_suffix(df, assets).collect()}
    assert got["HAR_RS_C_h1"] == ("HAR", "RS_C") and got["HAR_C_h22"] == ("HAR", "C") and "HAR_C_h1_ctx128" not in got


def test_csv_files_by_name(spark, tmp_path):
    for name, n in (("HAR_C_h1", 12), ("HAR_C_h5", 12), ("HAR_ES_h1", 3)):
        (tmp_path / f"{name}.csv").write_text("date,actual,forecast\n" + "".join(f"2020-01-{i + 1:02d},1.0,2.0\n" for i in range(n)))
    df = io.scan_forecast_files(spark, f"file://{tmp_path}", least=10)
    assert {(r.symbol, r.horizon) for r in df.select("symbol", "horizon").distinct().collect()} == {("C", 1), ("C", 5)}


def test_symbols_or_all_and_duplicates(spark):
    df = series(spark, [1, 2], "A").unionByName(series(spark, [1, 2], "B"))
    assert panels.symbols_or_all(df, ["B", "Z"]).count() == 2
    assert panels.symbols_or_all(df, ["Z"]).count() == 4
    assert panels.panel_duplicates(df.unionByName(series(spark, [9], "A"))).count() == 1


def test_student_tail(spark):
    def integrated(t, n):
        """The density's mass between -|t| and |t|, by Simpson's rule."""
        x = np.linspace(0, abs(t), 20_001)
        f = (1 + x * x / n) ** (-(n + 1) / 2) * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
        w = np.where(np.arange(len(x)) % 2, 4, 2)
        w[[0, -1]] = 1
        return 1 - 2 * float((f * w).sum()) * abs(t) / 20_000 / 3

    known = [(t, n, integrated(t, n)) for t, n in ((1.0, 1), (2.0, 10), (0.0, 5), (-2.0, 2), (2.0, 3), (1.96, 1000), (12.706205, 1), (3.0, 77))]
    assert math.isclose(known[0][2], 0.5, rel_tol=1e-9)
    df = spark.createDataFrame([(t, n) for t, n, _ in known] + [(None, 3), (1.0, 0)], "t double, n long")
    got = [r.p for r in df.select(t_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect()]
    for p, (*_, expected) in zip(got, known, strict=False):
        assert math.isclose(p, expected, rel_tol=2e-6)
    assert got[-2:] == [None, None]


def test_arma_falls_back_to_ar1(spark):
    # an exact AR(6): its first stage leaves no errors to lag, so that only the AR(1) can be fitted
    y = list(np.random.default_rng(3).normal(size=3))
    for _ in range(157):
        y.append(0.3 * y[-1] - 0.5 * y[-2] + 0.6 * y[-3])
    rv = np.exp(np.array(y) / 10 - 8)
    got = {(r.fold, r.refit): r.forecast for r in arma.arma_walk_forward(series(spark, [rv[0]] * 160), train=100, test=40, step=40, every=20, p=1, q=1).collect()}
    assert all(v is None for v in got.values())
    got = {(r.fold, r.refit): r.forecast for r in arma.arma_walk_forward(series(spark, rv), train=100, test=40, step=40, every=20, p=1, q=1, long_ar=6).collect()}
    for (fold, refit), value in got.items():
        z = np.log(rv)[fold * 40 : fold * 40 + 100 + refit * 20]
        x = np.column_stack([np.ones(len(z) - 1), z[:-1]])
        b, ssr, *_ = np.linalg.lstsq(x, z[1:], rcond=None)
        assert value is not None
        if math.isclose(value, math.exp(b @ [1, z[-1]] + float(ssr[0]) / (len(z) - 3) / 2), rel_tol=1e-6):
            break
    else:
        raise AssertionError("no refit fell back")


def test_routes(spark, tmp_path):
    f = forecasts(spark, [1, 2], {"A": [1, 1], "B": [2, 2]})
    path = f"file://{tmp_path}/routed"
    io.write_routed(f, path, F.when(F.col("model") == "A", 252).otherwise(512))
    assert {r.route for r in spark.read.parquet(path).select("route").collect()} == {"default", "window_512"}
    assert io.scan_forecasts(spark, f"{path}/route=window_512").select("model").distinct().collect()[0].model == "B"


def test_measures_cross_the_night(spark):
    """Measures by day against one pass over each symbol's ticks."""
    rng = np.random.default_rng(8)
    rows = [(s, DAY + dt.timedelta(days=int(d)), i, float(p)) for s in "AB" for i, (d, p) in enumerate(zip(np.sort(rng.integers(0, 12, 40)), rng.normal(size=40), strict=True))]
    rows.append(("C", DAY, 0, 1.0))
    got = {(r.symbol, r.date): r for r in realized_measures(spark.createDataFrame(rows, "symbol string, date date, i long, p double"), ["i"]).collect()}
    days = {}
    for s in "AB":
        own = [r for r in rows if r[0] == s]
        for before, now in zip(own, own[1:], strict=False):
            days.setdefault((s, now[1]), []).append(now[3] - before[3])
    assert set(got) == set(days)
    for k, r in days.items():
        r = np.array(r)
        expected = [(r**2).sum(), math.pi / 2 * np.abs(r[1:] * r[:-1]).sum(), (r[r > 0] ** 2).sum(), (r[r < 0] ** 2).sum(), len(r) / 3 * (r**4).sum()]
        assert np.allclose([got[k].rv, got[k].bv, got[k].good, got[k].bad, got[k].rq], expected)
