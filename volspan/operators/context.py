"""Sliding contexts and scorers that forecast from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspan.operators.features import by_symbol, position
from volspan.operators.scorers import arrow_columns, get_scorer, predicted, score


def contexts(df: DataFrame, length: int = 512, column: str = "rv") -> DataFrame:
    """symbol, date, pos and `context`: the `length` values before each row that has so many.

    An array per row is wide: use it in the stage that makes it.
    """
    w = by_symbol().rowsBetween(-length, -1)
    return df.withColumn("pos", position()).withColumn("context", F.collect_list(column).over(w)).where(F.col("pos") >= length)


def context_target(horizon: int = 1, column: str = "rv") -> Column:
    """Mean of the rows from the present one on, over those that are left at the end."""
    return F.col(column) if horizon == 1 else F.avg(column).over(by_symbol().rowsBetween(0, horizon - 1))


#: Scorers that are one window function over the values before a row: no array is made.
WINDOW_SCORERS: dict[str, Callable[[str], Column]] = {"last": lambda c: F.last(c, ignorenulls=True), "mean": lambda c: F.avg(c)}
def zero_shot(df: DataFrame, scorer: str = "last", horizon: int = 1, length: int = 512, column: str = "rv") -> DataFrame:
    """Forecasts from the `length` rows before each row: symbol, date, actual, forecast. Scorers that are a window function stay in
    columns; the others are those of `scorers`, run over blocks of rows."""
    if scorer in WINDOW_SCORERS:
        rows = df.withColumn("actual", context_target(horizon, column))
        w = by_symbol().rowsBetween(-length, -1)
        made = rows.withColumns({"pos": position(), "forecast": WINDOW_SCORERS[scorer](column).over(w)}).where(F.col("pos") >= length)
        return made.select("symbol", "date", "actual", "forecast")
    return score(df, scorer, horizon, length, column).select("symbol", "date", "actual", "forecast")


def score_contexts(made: DataFrame, scorer: str, horizon: int, samples: bool = False, **options) -> DataFrame:
    """Forecasts of a registered scorer from arrays `context` of any source, all of one length in a batch of rows or else handed over one by
    one: adds `point`, `lower`, `upper`, with `samples` also those, and the mean `forecast`. See `scorers.score` for series."""
    kept = [c for c in made.columns if c != "context"]
    source = made.select(*kept, F.col("context").cast("array<double>").alias("context"))
    lists = ["point", "lower", "upper", *(["samples"] if samples else [])]
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept) + ", point array<double>, lower array<double>, upper array<double>" + (", samples array<array<double>>" if samples else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = get_scorer(scorer, **options)
        for batch in batches:
            context = batch.column(len(kept))
            sizes = context.value_lengths().to_numpy(zero_copy_only=False)
            flat = context.flatten().to_numpy(zero_copy_only=False)
            parts = [flat.reshape(len(sizes), -1)] if len(set(sizes.tolist())) == 1 else [x[None] for x in np.split(flat, np.cumsum(sizes)[:-1])]
            scored = [s for part in parts for s in predicted(predict, part, horizon)]
            if scored:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrow_columns(scored, samples)], names=[*kept, *lists])

    return source.mapInArrow(run, schema).withColumn("forecast", F.aggregate("point", F.lit(0.0), lambda a, x: a + x, lambda a: a / horizon))


def summarize_samples(df: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """Per step: median, 10th and 90th percentile over the sample paths."""
    paths = df.select(*keys, F.explode(samples).alias("path"))
    steps = paths.select(*keys, F.posexplode("path").alias("step", "x"))
    q = F.percentile("x", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9)))
    return steps.groupBy(*keys, "step").agg(q.alias("q")).select(*keys, "step", F.col("q")[0].alias("point"), F.col("q")[1].alias("lower"), F.col("q")[2].alias("upper"))


def pick_quantiles(quantiles: Column, levels: list[float]) -> list[Column]:
    """Point, lower and upper from an array (per level) of arrays (per step)."""
    at = lambda q: F.element_at(quantiles, levels.index(q) + 1)
    return [at(0.5).alias("point"), at(0.1).alias("lower"), at(0.9).alias("upper")]


def scaled_interval(point: Column) -> list[Column]:
    return [F.transform(point, lambda x: x * 0.8).alias("lower"), F.transform(point, lambda x: x * 1.2).alias("upper")]


def trim_context(context: Column, length: int) -> Column:
    return F.slice(context, F.greatest(F.size(context) - length, F.lit(0)) + 1, length)


def pad_context(context: Column, length: int = 512) -> list[Column]:
    """The last `length` values with zeros before them, and the mask arrays of padding and of observed values."""
    held = trim_context(context, length)
    gap = F.lit(length) - F.size(held)
    return [
        F.concat(F.array_repeat(F.lit(0.0), gap), held).alias("padded"),
        F.concat(F.array_repeat(F.lit(1), gap), F.transform(held, lambda _: F.lit(0))).alias("is_pad"),
        F.concat(F.array_repeat(F.lit(0), gap), F.transform(held, lambda _: F.lit(1))).alias("observed"),
    ]


def business_dates(df: DataFrame, n: Column, end: str = "2025-01-01") -> DataFrame:
    """The `n` business days up to `end` for each row, numbered from 0, oldest first."""
    # two calendar days for each business day, and a week more, are always enough
    first = F.date_sub(F.to_date(F.lit(end)), (n * 2 + 7).cast("int"))
    days = F.filter(F.sequence(first, F.to_date(F.lit(end))), lambda d: F.weekday(d) < 5)
    kept = F.slice(days, F.size(days) - n.cast("int") + 1, n.cast("int"))
    return df.select(*df.columns, F.posexplode(kept).alias("i", "business_date"))


