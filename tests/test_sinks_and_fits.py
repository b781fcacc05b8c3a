"""Idempotent sinks, checked scans, refits from block sums and fits of least norm."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspan.operators import quantiles, walk
from volspan.sources import forecasts as io
from volspan.sources import panel

DAY = dt.date(2020, 1, 1)


def runs(spark, models, value=1.0, symbols=("007", "B"), days=5):
    rows = [(s, h, m, DAY + dt.timedelta(days=i), 1.0, value) for s in symbols for h in (1, 5) for m in models for i in range(days)]
    return spark.createDataFrame(rows, "symbol string, horizon int, model string, date date, actual double, forecast double").repartition(4)


def test_a_run_written_twice_is_there_once(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    assert io.committed_runs(spark, path).count() == 0
    io.write_forecasts(runs(spark, ["HAR-J", "AR 1"]), path)
    io.write_forecasts(runs(spark, ["HAR-J"], 2.0, symbols=("007",), days=3), path)
    got = io.scan_forecasts(spark, path).groupBy("symbol", "horizon", "model").agg(F.count("*").alias("n"), F.max("forecast").alias("f")).collect()
    assert {(r.symbol, r.horizon, r.model, r.n, r.f) for r in got} == {(s, h, m, *((3, 2.0) if (s, m) == ("007", "HAR_J") else (5, 1.0))) for s in ("007", "B") for h in (1, 5) for m in ("HAR_J", "AR_1")}
    listed = {(r.symbol, r.horizon, r.model, r.folder, r.rows) for r in io.committed_runs(spark, path).collect()}
    assert listed == {(s, h, m, f, 3 if (s, m) == ("007", "HAR-J") else 5) for s in ("007", "B") for h in (1, 5) for m, f in (("HAR-J", "HAR_J"), ("AR 1", "AR_1"))}
    grid = io.run_grid(spark.createDataFrame([("007",), ("C",)], "symbol string"), [1, 22], ["HAR-J"])
    assert {(r.symbol, r.horizon) for r in io.pending_in(grid, path).collect()} == {("007", 22), ("C", 1), ("C", 22)}


def test_names_that_clean_to_one_raise(spark, tmp_path):
    path = f"file://{tmp_path}/clash"
    with pytest.raises(ValueError, match="HAR-J, HAR.J would share the folder HAR_J"):
        io.write_runs(runs(spark, ["HAR-J", "HAR.J"]), path)
    assert not list((tmp_path / "clash").glob("model=*")) and io.committed_runs(spark, path).count() == 0
    io.write_runs(runs(spark, ["HAR-J"]), path)
    with pytest.raises(ValueError, match="share the folder"):
        io.write_runs(runs(spark, ["HAR J"]), path)
    assert io.scan_forecasts(spark, path).count() == 20


def test_a_job_that_ends_early_commits_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/early"
    fails = runs(spark, ["a"]).withColumn("forecast", F.when(F.col("symbol") == "B", F.raise_error(F.lit("lost"))).otherwise(F.col("forecast")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        io.write_runs(fails, path)
    assert io.committed_runs(spark, path).count() == 0
    io.write_runs(runs(spark, ["a"]), path)
    assert io.committed_runs(spark, path).count() == 4 and io.scan_forecasts(spark, path).count() == 20
    io.write_routed(runs(spark, ["a"]), f"{path}-routed", F.col("horizon") + 251)
    io.write_routed(runs(spark, ["a"], symbols=("B",)), f"{path}-routed", F.col("horizon") + 251)
    assert io.scan_forecasts(spark, f"{path}-routed/route=default").count() == 10


def test_rejects_are_kept_apart(spark, tmp_path):
    lines = ["date,symbol,rv5,bv5,rsp5,rsn5,rq5,note", "2020-01-01,A,1e-4,1,1,1,1,x", "2020-01-02 00:00:00,A,,1,1,1,1,x", "2020-13-01,A,1,1,1,1,1,x", "2020-01-03,,1,oops,1,1,1,x", "2020-01-04,A,1.2.3,1,1,n/a,1,x", "2020-01-05,A,1,1", "2020-01-06,B,NaN,2,2,2,2,"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([lines[0], "nonsense,B,1,1,1,1,1,x"]) + "\n")
    good, rejects = panel.scan_panel_checked(spark, f"file://{tmp_path}")
    rows = {(r.date.isoformat(), r.symbol): r for r in good.collect()}
    assert rows.keys() == {("2020-01-01", "A"), ("2020-01-02", "A"), ("2020-01-06", "B")}
    assert rows["2020-01-02", "A"].rv5 is None and math.isnan(rows["2020-01-06", "B"].rv5)
    found = {r.record.split(",")[0]: set(r.reasons) for r in rejects.collect()}
    assert found["2020-13-01"] == {"date"} and found["2020-01-03"] == {"symbol", "bv5"} and found["2020-01-04"] == {"rv5", "rsn5"} and "columns" in found["2020-01-05"] and found["nonsense"] == {"date"}
    counts = {(r.file.rsplit("/", 1)[1], r.reason): r.rejects for r in panel.rejects_by_file(rejects).collect()}
    assert counts["b.csv", "date"] == 1 and counts["a.csv", "date"] == 1 and counts["a.csv", "symbol"] == 1
    assert panel.scan_panel_checked(spark, f"file://{tmp_path}", ["B"])[0].count() == 1


def least_norm(x, y):
    return np.linalg.pinv(np.column_stack([np.ones(len(y)), x])) @ y


@pytest.mark.parametrize("case", ["repeated", "constant", "sum", "few rows", "full"])
def test_least_norm_equals_the_pseudo_inverse(spark, case):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3 if case == "few rows" else 40, 4)) * np.array([1, 0.1, 10, 1]) + np.array([0, 1, 5, -2])
    x[:, 3] = {"repeated": x[:, 0], "constant": np.full(len(x), 2.5), "sum": x[:, 0] - 2 * x[:, 1]}.get(case, x[:, 3])
    y = rng.normal(size=len(x)) + x[:, 0]
    rows = [("S", *map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "symbol string, a double, b double, c double, d double, y double")
    fit = walk.ols_fit(df, ["symbol"], ["a", "b", "c", "d"], minimum_norm=True).first()
    assert np.allclose([fit.const, fit.b_a, fit.b_b, fit.b_c, fit.b_d], least_norm(x, y), rtol=1e-6, atol=1e-8)
    design = np.column_stack([np.ones(len(y)), x])
    rank, left = np.linalg.matrix_rank(design), ((y - design @ least_norm(x, y)) ** 2).sum()
    assert fit.sigma2 is None if len(y) <= rank else math.isclose(fit.sigma2, left / (len(y) - rank), rel_tol=1e-8)
    plain = walk.ols_fit(df, ["symbol"], ["a", "b", "c", "d"]).first()
    assert (plain.const is None) == (case != "full") and plain.asDict().keys() == fit.asDict().keys()


def test_refits_equal_fits_of_their_rows(spark):
    rng = np.random.default_rng(8)
    rv = rng.gamma(2, 1e-4, 300) * (1 + np.arange(300) / 100)
    rows = [("S", DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(rv)]
    df = spark.createDataFrame(rows, "symbol string, date date, rv double")
    for train, test, step, every in ((60, 40, 40, 9), (50, 30, 20, 30), (40, 40, 40, 1)):
        got = {r.date: r for r in walk.refit_walk_forward(df, "HAR", 1, train, test, step, every).collect()}
        first = 22
        x = np.array([[rv[t - 1], rv[t - 5 : t].mean(), rv[t - 22 : t].mean()] for t in range(first, 300)])
        y = rv[first:]
        assert len(got) == len(y) - train
        for pos in range(train, len(y)):
            fold = max(0, -(-(pos - train - test + 1) // step))
            refit = (pos - fold * step - train) // every
            origin = fold * step + train + refit * every
            b = np.linalg.lstsq(np.column_stack([np.ones(origin - fold * step), x[fold * step : origin]]), y[fold * step : origin], rcond=None)[0]
            r = got[DAY + dt.timedelta(days=first + pos)]
            assert (r.fold, r.refit) == (fold, refit) and math.isclose(r.forecast, b[0] + b[1:] @ x[pos], rel_tol=1e-6)


def test_counted_quantiles(spark):
    """Ties, extremes, one row, infinities and nulls; few parts make many rounds."""
    rng = np.random.default_rng(9)
    groups = {"ties": [1.0] * 50 + [2.0] * 7, "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, 5e-324, 3.0], "one": [4.0], "normal": rng.normal(size=501).tolist(), "clustered": (10.0 ** rng.uniform(-200, 200, 97)).tolist()}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ties", None), ("ties", float("nan")), ("none", None), (None, 1.0), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "g string, v double").withColumns({"lo": F.lit("clash"), "rank": F.lit(1)})
    levels = [0.0, 0.1, 0.5, 0.995, 1.0]
    for buckets in (64, 1024):
        got = {(r.g, r.level): r.value for r in quantiles.exact_quantiles(df, ["g"], "v", levels, buckets).collect()}
        assert got.keys() == {(g, x) for g in groups for x in levels}
        for (g, x), v in got.items():
            assert math.isclose(v, float(np.quantile(np.array(groups[g], np.longdouble), x)), rel_tol=1e-9, abs_tol=1e-320), (g, x)
    assert quantiles.exact_quantiles(df.where("false"), ["g"], "v", [0.5]).count() == 0
