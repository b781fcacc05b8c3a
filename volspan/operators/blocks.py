"""Window operators on series of any length: a series is cut into blocks of rows, and no task sees all of it.

- `positions` numbers the rows of a series: counts by stretch of dates first, then row numbers within
  each stretch behind the counts of those before.
- `in_blocks` runs a function of lagged and rolling windows over blocks of `size` rows, each with a halo of the
  rows around it: rows are copied once or twice at most, however wide the windows.
- `running` gives running sums: sums of blocks first, then those within a block behind them.

Only one row per stretch or block meets in a window of the whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspan.functions.numeric import clip_low
from volspan.operators import compare
from volspan.operators.features import BUILDERS, LOG_FLOOR, REGRESSORS, target
from volspan.sources.panel import observed

#: Rows of a block.
SIZE = 4096


def by_year(order: str = "date") -> Column:
    """A stretch of dates that holds few rows of a daily series; it must grow with the order."""
    return F.year(F.col(order))


def positions(df: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "date", stretch: Column | None = None, name: str = "pos") -> DataFrame:
    """Adds the number of each row of a series by `order`, from 0. `stretch` (default: the year) must grow with the order."""
    keys = list(keys)
    x = df.withColumn("stretch of row", by_year(order) if stretch is None else stretch)
    before = Window.partitionBy(*keys).orderBy("stretch of row").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy(*keys, "stretch of row").agg(F.count("*").alias("rows of stretch"))
    counts = counts.select(*keys, "stretch of row", F.coalesce(F.sum("rows of stretch").over(before), F.lit(0)).alias("rows before"))
    own = F.row_number().over(Window.partitionBy(*keys, "stretch of row").orderBy(order)) - 1
    x = x.withColumn(name, own.cast("long")).join(counts, [*keys, "stretch of row"])
    return x.withColumn(name, F.col(name) + F.col("rows before")).drop("stretch of row", "rows before").select(*df.columns, name)


def with_halo(df: DataFrame, before: int, after: int = 0, size: int = SIZE, pos: str = "pos") -> DataFrame:
    """Adds `block`: each row once in its own block, and in the next or last one if it is one of their rows `before` or `after`."""
    if max(before, after) > size:
        raise ValueError(f"a halo of {max(before, after)} rows needs blocks of as many; these have {size}")
    b, within = F.floor(F.col(pos) / size), F.col(pos) % size
    near = F.array(b, F.when(within >= size - before, b + 1), F.when((within < after) & (b > 0), b - 1))
    return df.withColumn("block", F.explode(F.filter(near, lambda x: x.isNotNull())))


def in_blocks(df: DataFrame, transform: Callable[[DataFrame], DataFrame], before: int, after: int = 0, size: int = SIZE, key: str = "symbol", pos: str = "pos") -> DataFrame:
    """`transform` of a table whose windows, by `key`, look back `before` and ahead `after` rows at most, block by block.

    The key is a struct of key and block while `transform` runs, so windows partition by both. It must keep `pos`
    and the rows, or drop rows by values only; rows of halos go.
    """
    x = with_halo(df, before, after, size, pos)
    x = x.withColumn(key, F.struct(F.col(key).alias("key"), F.col("block").alias("block"))).drop("block")
    out = transform(x).where(F.floor(F.col(pos) / size) == F.col(key)["block"])
    return out.withColumn(key, F.col(key)["key"])


def running(df: DataFrame, sums: dict[str, Column], keys: Sequence[str] = ("symbol",), size: int = SIZE, pos: str = "pos") -> DataFrame:
    """Adds the running sum of each expression up to and with its row; nulls count as 0."""
    keys = list(keys)
    values = {f"value of {n}": F.coalesce(e, F.lit(0.0)) for n, e in sums.items()}
    x = df.withColumns(values | {"block of row": F.floor(F.col(pos) / size)})
    earlier = Window.partitionBy(*keys).orderBy("block of row").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*keys, "block of row").agg(*[F.sum(f"value of {n}").alias(f"total of {n}") for n in sums])
    totals = totals.select(*keys, "block of row", *[F.coalesce(F.sum(f"total of {n}").over(earlier), F.lit(0.0)).alias(f"before {n}") for n in sums])
    within = Window.partitionBy(*keys, "block of row").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({n: F.sum(f"value of {n}").over(within) for n in sums}).join(totals, [*keys, "block of row"])
    return x.withColumns({n: F.col(n) + F.col(f"before {n}") for n in sums}).select(*df.columns, *sums)


def model_features(df: DataFrame, model: str, horizon: int = 1, size: int = SIZE, stretch: Column | None = None, monthly: int = 22, **windows: int) -> DataFrame:
    """`features.features_for_model` of series of any length: the same columns and rows."""
    rows = positions(observed(df, *{"HAR_J": ("rv", "jump"), "HAR_RS": ("rv", "good", "bad"), "HARQ": ("rv", "rq")}.get(model, ("rv",))), stretch=stretch)
    back = max(monthly, *windows.values(), 1) + 1

    def made(x: DataFrame) -> DataFrame:
        x = BUILDERS[model](x, monthly=monthly, **windows).withColumn("actual", target("rv", horizon))
        y = F.ln(clip_low(F.col("actual"), LOG_FLOOR)) if model == "Log_HAR" else F.col("actual")
        return x.select("symbol", "date", "pos", *REGRESSORS[model], "actual", y.alias("y"))

    out = in_blocks(rows, made, back, horizon, size).drop("pos").dropna(subset=[*REGRESSORS[model], "y"])
    return positions(out, stretch=stretch)


def mz_recursive(df: DataFrame, least: int = 252, size: int = SIZE, stretch: Column | None = None) -> DataFrame:
    """`compare.mz_recursive` of series of any length: coefficients from running sums of centred values."""
    keys = compare.SERIES
    x = positions(df, keys, stretch=stretch)
    base = df.groupBy(*keys).agg(F.avg("actual").alias("mean of actual"), F.avg("forecast").alias("mean of forecast"), F.max(F.abs("forecast")).alias("largest forecast"))
    x = x.join(base, keys)
    a, f = F.col("actual") - F.col("mean of actual"), F.col("forecast") - F.col("mean of forecast")
    x = running(x, {"s_a": a, "s_f": f, "s_ff": f * f, "s_af": a * f}, keys, size)
    n, own = F.col("pos"), {"s_a": a, "s_f": f, "s_ff": f * f, "s_af": a * f}
    s = {k: F.col(k) - e for k, e in own.items()}  # of the rows before
    var = s["s_ff"] - s["s_f"] * s["s_f"] / n
    slope = F.when(var > n * F.pow(F.col("largest forecast") * 1e-12, 2), (s["s_af"] - s["s_a"] * s["s_f"] / n) / var)
    level = F.col("mean of actual") + s["s_a"] / n + slope * (f - s["s_f"] / n)
    corrected = F.when(F.col("pos") >= least, F.coalesce(level, F.col("forecast")))
    return x.withColumn("corrected", corrected).select(*df.columns, "pos", "corrected")


def gr_path(diff: DataFrame, keys: Sequence[str] = tuple(compare.SERIES), share: float = 0.3, lags: int = 1, least: int = 30, size: int = SIZE, stretch: Column | None = None) -> DataFrame:
    """`compare.gr_path` of series of any length: products of neighbours and shifted sums with halos, running sums in two
    passes, and the self equi-join m rows back."""
    keys, ks = list(keys), range(1, lags + 1)
    x = positions(diff.select(*keys, "date", "d"), keys, stretch=stretch)
    whole = diff.groupBy(*keys).agg(F.avg("d").alias("base"), F.count("*").alias("T"))
    x = x.join(whole, keys).withColumn("e", F.col("d") - F.col("base"))
    x = x.withColumn("m", F.greatest(F.floor(F.col("T") * share), F.lit(least)).cast("long")).withColumn("series", F.struct(*keys))
    w = Window.partitionBy("series").orderBy("pos")
    x = in_blocks(x, lambda t: t.withColumns({f"p_{k}": F.col("e") * F.lag("e", k).over(w) for k in ks}), lags, 0, size, "series")
    x = running(x, {"cum_e": F.col("e"), "q_0": F.col("e") * F.col("e")} | {f"q_{k}": F.col(f"p_{k}") for k in ks}, keys, size)

    def shifted(t: DataFrame) -> DataFrame:
        t = t.withColumns({f"early_{k}": F.coalesce(F.lag("cum_e", k).over(w), F.lit(0.0)) for k in ks})
        return t.withColumns({f"f_{k}": F.lead("cum_e", k).over(w) for k in ks} | {f"h_{k}": F.lead(f"q_{k}", k).over(w) for k in ks})

    x = in_blocks(x, shifted, lags, lags, size, "series")
    heads = x.where(F.col("pos") < lags).groupBy(*keys).agg(*[F.max(F.when(F.col("pos") == k - 1, F.col("cum_e"))).alias(f"head_{k}") for k in ks])
    return compare.gr_statistics(x.join(heads, keys), keys, lags)


def gr_fluctuation(diff: DataFrame, keys: Sequence[str] = tuple(compare.SERIES), share: float = 0.3, lags: int = 1, **blocks) -> DataFrame:
    return compare.gr_decisions(gr_path(diff, keys, share, lags, **blocks), keys)
