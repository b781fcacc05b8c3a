"""Series cut into blocks against windows over the whole, and scorers on sliding contexts."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from volspan.operators import blocks, compare, context, features, scorers

DAY = dt.date(2019, 11, 20)


@pytest.fixture(scope="module")
def panel(spark):
    """Three series of 2 to 150 rows across three years, with holes."""
    rng = np.random.default_rng(1)
    rows = []
    for s, n in (("A", 150), ("B", 67), ("C", 2)):
        for i in range(n):
            rv, jump, good, bad, rq = rng.gamma(2, 1e-4, 5)
            rows.append((s, DAY + dt.timedelta(days=4 * i), float(rv) if i % 17 else None, float(jump) if i % 11 else None, float(good), float(bad) if i % 23 else float("nan"), float(rq)))
    return spark.createDataFrame(rows, "symbol string, date date, rv double, jump double, good double, bad double, rq double").repartition(3)


def as_sets(df, digits=9):
    return {tuple(f"{v:.{digits}g}" if isinstance(v, float) else v for v in r) for r in df.collect()}


def test_positions_halos_and_running_sums(spark, panel):
    numbered = blocks.positions(panel)
    whole = panel.withColumn("pos", features.position())
    assert as_sets(numbered) == as_sets(whole) and numbered.columns == whole.columns
    by_month = blocks.positions(panel, stretch=F.date_format("date", "yyyyMM"))
    assert as_sets(by_month) == as_sets(whole)
    w = Window.partitionBy("symbol").orderBy("pos")
    looks = lambda t: t.withColumns({"back": F.lag("rv", 3).over(w), "ahead": F.lead("good", 2).over(w), "n": F.count("rv").over(w.rowsBetween(-3, 2))})
    for size in (3, 7, 64, 4096):
        assert as_sets(blocks.in_blocks(numbered, looks, 3, 2, size)) == as_sets(looks(whole))
        sums = blocks.running(numbered, {"s": F.col("rv"), "g": F.col("good") * 2}, size=size)
        expected = whole.withColumns({"s": F.sum(F.coalesce("rv", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)), "g": F.sum(F.col("good") * 2).over(w.rowsBetween(Window.unboundedPreceding, 0))})
        assert as_sets(sums) == as_sets(expected.select(sums.columns))
    copies = blocks.with_halo(numbered, 3, 2, 10).groupBy("symbol", "pos").count().agg(F.max("count")).first()[0]
    assert copies == 2
    with pytest.raises(ValueError, match="halo"):
        blocks.in_blocks(numbered, looks, 9, 2, 8)
    assert blocks.positions(panel.where("false")).count() == 0


@pytest.mark.parametrize(("model", "horizon"), [("HAR", 5), ("HAR_J", 1), ("HAR_RS", 1), ("HARQ", 22), ("Log_HAR", 3)])
def test_model_features_in_blocks(panel, model, horizon):
    df = panel if model != "HAR_RS" else panel.where("not isnan(bad)")
    whole = features.features_for_model(df, model, horizon)
    cut = blocks.model_features(df, model, horizon, size=32)
    assert cut.columns == whole.columns and as_sets(cut) == as_sets(whole) and whole.count() > 0


def test_no_window_sees_a_whole_series(panel):
    """Windows over rows are partitioned by stretch or block as well; those over a bare symbol take one row per stretch."""
    plan = blocks.model_features(panel, "HAR")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for line in windows:
        spec = line[line.rindex(", [", 0, line.rindex(", [")) :]
        assert "stretch of row" in spec or "row_number" not in line, line
        assert "symbol" in spec


def long_forecasts(spark, n, seed):
    rng = np.random.default_rng(seed)
    a = rng.gamma(2, 1, n)
    made = {"x": a * rng.uniform(0.8, 1.3, n), "y": np.full(n, 0.5), "z": rng.gamma(2, 1, n)}
    rows = [("S", 1, m, DAY + dt.timedelta(days=i), float(a[i]), float(f[i])) for m, f in made.items() for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, horizon int, model string, date date, actual double, forecast double")


def test_recursive_correction_and_fluctuation_in_blocks(spark):
    df = long_forecasts(spark, 140, 3)
    assert as_sets(blocks.mz_recursive(df, 20, size=16).drop("pos"), 8) == as_sets(compare.mz_recursive(df, 20).drop("pos"), 8)
    diff = compare.against_benchmark(compare.losses(df, "MSE"), "z")
    for lags in (1, 3):
        whole, cut = compare.gr_path(diff, compare.SERIES, lags=lags), blocks.gr_path(diff, lags=lags, size=16)
        assert as_sets(cut.select(whole.columns), 7) == as_sets(whole, 7) and whole.count() == 2 * (140 - 42 + 1)
    both = [as_sets(f(diff, compare.SERIES).drop("reject_10", "reject_5"), 7) for f in (compare.gr_fluctuation, blocks.gr_fluctuation)]
    assert both[0] == both[1]


def test_what_scorers_return():
    contexts = np.arange(60.0).reshape(3, 20)
    paths = scorers.get_scorer("past_paths", paths=4)(contexts, 5).complete()
    assert paths.samples.shape == (3, 4, 5) and np.array_equal(paths.point, np.median(contexts.reshape(3, 4, 5), axis=1))
    assert np.array_equal(paths.upper, np.quantile(contexts.reshape(3, 4, 5), 0.9, axis=1))
    levels = scorers.get_scorer("past_quantiles")(contexts, 2).complete()
    assert np.allclose(levels.lower, np.quantile(contexts, 0.1, axis=1)[:, None]) and levels.point.shape == (3, 2)
    point = scorers.get_scorer("last")(contexts, 3).complete()
    assert np.array_equal(point.point, np.repeat(contexts[:, -1:], 3, 1)) and np.allclose(point.lower, 0.8 * point.point) and np.allclose(point.upper, 1.2 * point.point)
    own = scorers.Scored(point=contexts[:, :1], upper=contexts[:, 1:2]).complete()
    assert np.array_equal(own.upper, contexts[:, 1:2]) and np.allclose(own.lower, 0.8 * contexts[:, :1])
    with pytest.raises(ValueError, match="must return"):
        scorers.Scored().complete()
    with pytest.raises(ValueError, match="unknown scorer"):
        scorers.get_scorer("none such")


def test_a_scorer_is_made_once_and_gets_bounded_batches():
    made, seen = [], []

    @scorers.register("counting")
    def counting(scale=1.0):
        made.append(scale)

        def predict(contexts, steps):
            seen.append(contexts.nbytes)
            return scorers.Scored(scale * contexts[:, -steps:])

        return predict

    for _ in range(3):
        out = scorers.predicted(scorers.get_scorer("counting", scale=2.0), np.ones((100, 10)), 2, batch_bytes=800)
    assert made == [2.0] and max(seen) <= 800 and sum(len(s.point) for s in out) == 100
    scorers.get_scorer("counting", scale=3.0)
    assert made == [2.0, 3.0]


def test_scores_of_series(spark, panel):
    """Sliding contexts of blocks equal those of arrays, at every block size; targets at the end are truncated means."""
    values = {s: [r.rv for r in panel.where("rv is not null").where(F.col("symbol") == s).orderBy("date").collect()] for s in "ABC"}
    dates = {s: [r.date for r in panel.where("rv is not null").where(F.col("symbol") == s).orderBy("date").collect()] for s in "ABC"}
    for size in (24, 40, 4096):
        got = {(r.symbol, r.date): r for r in scorers.score(panel, "past_paths", 3, length=24, size=size, samples=True, paths=8).collect()}
        assert len(got) == sum(max(0, len(v) - 24) for v in values.values())
        for s, v in values.items():
            for i in range(24, len(v)):
                r, c = got[s, dates[s][i]], np.array(v[i - 24 : i]).reshape(8, 3)
                assert np.allclose(r.samples, c) and np.allclose(r.point, np.median(c, 0)) and np.allclose(r.lower, np.quantile(c, 0.1, 0))
                assert math.isclose(r.actual, np.mean(v[i : i + 3])) and math.isclose(r.forecast, np.median(c, 0).mean())
    plain = scorers.score(panel, "mean", 1, length=24, samples=True, rows=5).where("symbol = 'A'").orderBy("date").collect()
    assert plain[0].samples is None and math.isclose(plain[0].point[0], np.mean(values["A"][19:24])) and math.isclose(plain[0].actual, values["A"][24])
    assert scorers.score(panel.where("false"), "last").count() == 0 and scorers.score(panel.where("symbol = 'C'"), "last").count() == 0
    arrays = context.contexts(panel.where("rv is not null").select("symbol", "date", "rv"), 24).select("symbol", "date", "context")
    a = {(r.symbol, r.date): r.forecast for r in context.score_contexts(arrays, "median", 2).collect()}
    b = {(r.symbol, r.date): r.forecast for r in scorers.score(panel, "median", 2, length=24).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)
    uneven = spark.createDataFrame([(1, [1.0, 2.0, 6.0]), (2, [4.0])], "id int, context array<double>").coalesce(1)
    assert {r.id: (r.point, r.forecast) for r in context.score_contexts(uneven, "mean", 2).collect()} == {1: ([3.0, 3.0], 3.0), 2: ([4.0, 4.0], 4.0)}
