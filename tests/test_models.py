"""Exact-likelihood ARMA, pairwise tests and confidence sets against brute force."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspan.operators import arma_ml, compare, mcs

DAY = dt.date(2020, 1, 1)


def simulated(rng, n, phi, theta, level=-9.0):
    e = rng.normal(size=n + 300) * 0.5
    x = np.zeros(n + 300)
    for t in range(5, n + 300):
        x[t] = sum(c * x[t - 1 - i] for i, c in enumerate(phi)) + e[t] + sum(c * e[t - 1 - i] for i, c in enumerate(theta))
    return x[300:] + level


def dense(y, phi, theta):
    """Log-likelihood, mean, variance and one-step forecast from the whole covariance matrix."""
    n, m = len(y), 1500
    psi = np.zeros(m)
    psi[0] = 1
    for k in range(1, m):
        psi[k] = (theta[k - 1] if k <= len(theta) else 0) + sum(c * psi[k - 1 - i] for i, c in enumerate(phi) if k - 1 - i >= 0)
    gamma = np.array([psi[: m - k] @ psi[k:] for k in range(n + 1)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    root = np.linalg.cholesky(cov)
    a, b = np.linalg.solve(root, y), np.linalg.solve(root, np.ones(n))
    mean = (a @ b) / (b @ b)
    r = a - mean * b
    s2 = r @ r / n
    ahead = mean + gamma[n:0:-1] @ np.linalg.solve(cov, y - mean)
    return -0.5 * n * (math.log(2 * math.pi * s2) + 1) - np.log(np.diag(root)).sum(), mean, s2, ahead


def climbed(y, p, q, rng, tries=40, rounds=300):
    """The best likelihood that a pattern search finds from many starts, over the same angles: likelihood and one-step forecast."""

    def value(u):
        lanes = len(u)
        with np.errstate(all="ignore"):
            f = arma_ml.Filtered(np.repeat((y - y.mean())[:, None], lanes, 1), np.full(lanes, len(y)), *arma_ml.coefficients(u, p))
        return np.nan_to_num(f.log_likelihood(), nan=-np.inf), f.path(1)[:, 0] + y.mean()

    k = p + q
    u, step = rng.uniform(-1.5, 1.5, (tries, k)), np.full(tries, 0.4)
    now = value(u)[0]
    for _ in range(rounds):
        d = np.concatenate([np.eye(k), rng.normal(size=(2, k))])
        moved = u[:, None] + step[:, None, None] * np.concatenate([d, -d])
        values = value(moved.reshape(-1, k))[0].reshape(tries, -1)
        i = values.argmax(1)
        up = values[np.arange(tries), i] > now
        u[up], now[up] = moved[np.arange(tries), i][up], values[np.arange(tries), i][up]
        step = np.where(up, step * 1.3, np.maximum(step / 2, 1e-7))
    return now.max(), value(u[[int(now.argmax())]])[1][0]


def test_filter_is_the_dense_likelihood():
    rng = np.random.default_rng(1)
    series = [simulated(rng, n, phi, theta) for n, phi, theta in ((90, [0.8], [0.3]), (140, [1.2, -0.3], [-0.5, 0.1]), (60, [0.2, 0.5], [0.9]))]
    for p, q in ((1, 0), (1, 1), (2, 2), (0, 1), (3, 1)):
        for y, out in zip(series, arma_ml.fit_series(series, p, q, steps=2), strict=True):
            ll, mean, s2, ahead = dense(y, out["ar"], out["ma"])
            assert math.isclose(out["log_likelihood"], ll, rel_tol=1e-7) and math.isclose(out["const"], mean, rel_tol=1e-6)
            assert math.isclose(out["sigma2"], s2, rel_tol=1e-6) and math.isclose(out["path"][0], ahead, rel_tol=1e-6)
            k = len(out["ar"]) + len(out["ma"]) + 2
            assert math.isclose(out["aic"], 2 * k - 2 * ll, rel_tol=1e-7) and math.isclose(out["bic"], k * math.log(len(y)) - 2 * ll, rel_tol=1e-7)
            assert math.isclose(out["mse"], np.mean(np.square(out["residuals"])), rel_tol=1e-9) and len(out["residuals"]) == len(y)


@pytest.mark.parametrize(("p", "q", "phi", "theta"), [(1, 0, [0.7], []), (1, 1, [0.9], [-0.5]), (2, 1, [0.5, 0.3], [0.4])])
def test_no_likelier_model_is_found(p, q, phi, theta):
    """Forecasts within 1e-4 of the most likely model's; of several optima a slightly less likely one may be taken."""
    rng = np.random.default_rng(10 * p + q)
    same = 0
    for _ in range(4):
        y = simulated(rng, 90, phi, theta)
        best, out = climbed(y, p, q, rng), arma_ml.fit_series([y], p, q)[0]
        assert out["model"] == f"ARMA({p},{q})" and out["log_likelihood"] > best[0] - 0.1
        if out["log_likelihood"] > best[0] - 1e-5:
            assert abs(out["path"][0] - best[1]) < 1e-4
            same += 1
    assert same >= (3 if p + q > 2 else 4)


def test_fallbacks_of_arma():
    rng = np.random.default_rng(3)
    y = simulated(rng, 120, [0.6], [])
    out = arma_ml.fit_series([y, np.full(60, -3.0), y[:9]], 2, 2, most_steps=1)
    assert [o["model"] for o in out] == ["ARMA(1,0)", "mean", "mean"]  # not settled; no variance; too short
    assert out[1]["path"] == [-3.0] and out[1]["log_likelihood"] is None
    assert arma_ml.fit_series([y], 1, 0, most_steps=1)[0]["model"] == "ARMA(1,0)"


def test_walk_forward_of_arma(spark):
    """Forecasts stand from one refit to the next and are those of single fits; residual rows come by date."""
    rng = np.random.default_rng(4)
    rv = np.exp(simulated(rng, 460, [0.9], [-0.4]))
    rows = [("S", DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(rv)] + [("T", DAY, 1.0), ("T", DAY + dt.timedelta(days=1), None)]
    df = spark.createDataFrame(rows, "symbol string, date date, rv double")
    got = {r.date: r for r in arma_ml.arma_ml_walk_forward(df, horizon=3, p=1, q=1).collect()}
    assert len(got) == 460 - 252 - 2 and {r.fold for r in got.values()} == {0, 1}
    for fold, refit in ((0, 0), (0, 5), (1, 2)):
        start, origin = 126 * fold, 126 * fold + 252 + 22 * refit
        one = arma_ml.fit_series([np.log(rv[start:origin])], 1, 1)[0]
        for pos in range(origin, min(origin + 22, 126 * fold + 378)):
            r = got[DAY + dt.timedelta(days=pos)]
            assert (r.fold, r.refit) == (fold, refit) and math.isclose(r.forecast, math.exp(one["path"][0] + one["mse"] / 2), rel_tol=1e-5)
            assert math.isclose(r.actual, rv[pos : pos + 3].mean()) and math.isclose(r.aic, one["aic"], rel_tol=1e-6)
    fits = arma_ml.arma_fit(df, 1, 1, steps=4)
    whole = fits.first()
    assert fits.count() == 1 and len(whole.path) == 4
    left = [r.residual for r in arma_ml.residual_rows(df, fits).orderBy("date").collect()]
    assert np.allclose(left, whole.residuals) and len(left) == 460
    assert arma_ml.arma_ml_walk_forward(df.where("false")).count() == 0


def long_losses(spark, wide, names, horizon=1):
    rows = [("S", horizon, m, DAY + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for j, m in enumerate(names) for i, v in enumerate(wide[:, j])]
    return spark.createDataFrame(rows, "symbol string, horizon int, model string, date date, loss double").withColumn("n", F.lit("clash"))


def test_pairs_with_holes_and_many_lags(spark, monkeypatch):
    """Fifteen models a month and more ahead; where a model lacks dates, a pair has those of both."""
    rng = np.random.default_rng(5)
    wide = rng.gamma(2, 1, (160, 15))
    wide[:7, 3], wide[60:70, 4], wide[155:, 9] = np.nan, np.nan, np.nan
    wide[:, 14] = wide[:, 2]
    names = [f"m{j:02d}" for j in range(15)]
    monkeypatch.setattr(compare, "PAIR_CELLS", 900)
    for horizon, lags in ((22, None), (60, None), (1, 5)):
        got = {(r.model_i, r.model_j): r for r in compare.dm_test(long_losses(spark, wide, names, horizon), lags=lags).collect()}
        assert len(got) == 105
        for i in range(15):
            for j in range(i + 1, 15):
                d = wide[:, i] - wide[:, j]
                d = d[~np.isnan(d)]
                k_most, e = (horizon - 1 if lags is None else lags), d - d.mean()
                v = (e @ e) / len(d) + sum(2 * (1 - k / (k_most + 1)) * (e[k:] @ e[:-k]) / (len(d) - k) for k in range(1, k_most + 1))
                v = (v if v > 0 else (e @ e) / len(d)) / len(d)
                r = got[names[i], names[j]]
                assert r.n == len(d) and math.isclose(r.mean_diff, d.mean(), abs_tol=1e-12)
                assert (r.statistic is None) if (i, j) == (2, 14) else math.isclose(r.statistic, d.mean() / math.sqrt(v), rel_tol=1e-8, abs_tol=1e-12)
    assert compare.dm_test(long_losses(spark, wide[:0], names)).count() == 0


def test_lags_beyond_the_columns_raise(spark):
    a = np.arange(1.0, 41.0)
    rows = [("S", 30, "m", DAY + dt.timedelta(days=i), float(v), float(v * 1.1 + i % 3)) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "symbol string, horizon int, model string, date date, actual double, forecast double")
    with pytest.raises(Exception, match="give most_lags"):
        compare.mz_regression(df, F.col("horizon") - 1).collect()
    assert compare.mz_regression(df, F.col("horizon") - 1, most_lags=29).first().n == 40


def eliminated(wide, starts, block, alpha):
    """The set step by step: index arrays, all pairs of survivors, the worst goes while it is told apart."""
    t = len(wide)
    index = np.stack([np.concatenate([np.arange(s, s + block) for s in row])[:t] for row in starts])
    boot = np.stack([wide[index, m].mean(1) for m in range(wide.shape[1])], 1)
    alive, p_of, p = list(range(wide.shape[1])), {}, 1.0
    while len(alive) > 1:
        i, j = np.triu_indices(len(alive), 1)
        means, b = wide[:, alive].mean(0), boot[:, alive]
        d, o = b[:, i] - b[:, j], means[i] - means[j]
        sd = np.sqrt(np.maximum(d.var(0), 1e-30))
        p = float((np.abs((d - o) / sd).max(1) >= np.abs(o / sd).max()).mean())
        if p >= alpha:
            break
        p_of[alive.pop(int(np.argmax(means)))] = p
    return {m: (m in alive, max(p, alpha) if m in alive else p_of[m]) for m in range(wide.shape[1])}


def test_sets_equal_elimination(spark):
    rng = np.random.default_rng(6)
    base = rng.gamma(2, 1, (131, 1))
    wide = base + rng.gamma(1, 0.5, (131, 9)) * np.linspace(0.9, 1.1, 9) + np.array([0, 0, 0, 0, 0, 0.2, 0.4, 0.8, 1.6])
    names = [f"m{j}" for j in rng.permutation(9)]
    loss = long_losses(spark, wide, names)
    for draws, made in (("seeded", mcs.seeded_starts), ("hashed", mcs.hashed_starts)):
        expected = eliminated(wide, made(131, 400, 10, 42), 10, 0.1)
        got = {r.model: r for r in mcs.mcs(loss, replicates=400, block=10, draws=draws).collect()}
        assert 1 < sum(kept for kept, _ in expected.values()) < 9
        for j, m in enumerate(names):
            assert got[m].in_mcs == expected[j][0] and math.isclose(got[m].mcs_pvalue, expected[j][1], abs_tol=1e-12)
            assert math.isclose(got[m].mean, wide[:, j].mean()) and got[m]["rank"] == 1 + sum(wide[:, i].mean() < wide[:, j].mean() for i in range(9))
    short = mcs.mcs(long_losses(spark, wide[:9], names), block=10, replicates=20).collect()
    assert all(r.in_mcs and r.mcs_pvalue == 1.0 for r in short)


def test_draws(spark):
    """Seeded starts are those of the generator asked replicate by replicate; hashed ones are the table's."""
    for t, block in ((131, 22), (44, 22), (22, 22), (60, 7)):
        generator = np.random.RandomState(42)
        one_by_one = np.stack([generator.randint(0, t - block + 1, size=-(-t // block)) for _ in range(10_000)])
        assert np.array_equal(mcs.seeded_starts(t, 10_000, block, 42), one_by_one)
        table = mcs.block_bootstrap(spark.createDataFrame([(t,)], "T long"), block, 50, 7).collect()
        hashed = mcs.hashed_starts(t, 50, block, 7)
        assert len(table) == hashed.size and all(hashed[r.b, r.j] == r.start for r in table)
