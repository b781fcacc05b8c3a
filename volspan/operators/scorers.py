"""Models that forecast from a context: their interface, a registry, and their run over series.

A scorer takes a matrix of contexts (one a row, oldest value first) and a number of steps, and returns a
`Scored`: point paths, interval bounds, sample paths or quantiles, whatever it has. What is missing is
derived: from samples their median and 10th and 90th percentile, from quantiles those levels,
otherwise an interval of 0.8 and 1.2 times the point.

`score` never builds an array of contexts in Spark: a worker gets a block of a series with a halo of the
rows before it, once, and contexts are sliding views of it, so what is shuffled and held does not
grow with the context's length. Contexts are handed over in batches of at most
`BATCH_BYTES`. A scorer is made once in the life of a worker process, however many tasks it serves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspan.operators.blocks import SIZE, positions, with_halo
from volspan.sources.panel import observed

BATCH_BYTES = 8 << 20
LOW, HIGH = 0.1, 0.9
SHRINK, STRETCH = 0.8, 1.2


@dataclass(frozen=True)
class Scored:
    """Arrays by context: `point`, `lower`, `upper` (context, step), `samples` (context, path, step), and
    `quantiles` (context, level, step) at `levels`."""

    point: np.ndarray | None = None
    lower: np.ndarray | None = None
    upper: np.ndarray | None = None
    samples: np.ndarray | None = None
    quantiles: np.ndarray | None = None
    levels: tuple[float, ...] = ()

    def complete(self) -> Scored:
        point, lower, upper = self.point, self.lower, self.upper
        if self.samples is not None:
            low, middle, high = np.quantile(self.samples, [LOW, 0.5, HIGH], axis=1)
        elif self.quantiles is not None:
            low, middle, high = (self.quantiles[:, self.levels.index(x)] for x in (LOW, 0.5, HIGH))
        elif point is not None:
            low, middle, high = SHRINK * point, point, STRETCH * point
        else:
            raise ValueError("a scorer must return points, samples or quantiles")
        return replace(self, point=middle if point is None else point, lower=low if lower is None else lower, upper=high if upper is None else upper)


Scorer = Callable[[np.ndarray, int], Scored]
REGISTRY: dict[str, Callable[..., Scorer]] = {}
_held: dict[tuple, Scorer] = {}


def register(name: str):
    """Name a function of options that makes a scorer. Its module must be importable on the workers."""

    def add(make: Callable[..., Scorer]) -> Callable[..., Scorer]:
        REGISTRY[name] = make
        return make

    return add


def get_scorer(name: str, **options) -> Scorer:
    """The scorer of this process with that name and options, made when first asked for."""
    if name not in REGISTRY:
        raise ValueError(f"unknown scorer {name!r}; registered are {', '.join(sorted(REGISTRY))}")
    key = (name, *sorted(options.items()))
    if key not in _held:
        _held[key] = REGISTRY[name](**options)
    return _held[key]


@register("last")
def last_value() -> Scorer:
    return lambda contexts, steps: Scored(np.repeat(contexts[:, -1:], steps, axis=1))


@register("mean")
def mean_value(rows: int | None = None) -> Scorer:
    """Mean of the context, or of its last `rows`."""
    return lambda contexts, steps: Scored(np.repeat(contexts[:, -(rows or contexts.shape[1]) :].mean(axis=1, keepdims=True), steps, axis=1))


@register("median")
def median_value() -> Scorer:
    return lambda contexts, steps: Scored(np.repeat(np.median(contexts, axis=1)[:, None], steps, axis=1))


@register("past_paths")
def past_paths(paths: int = 20) -> Scorer:
    """The last `paths` stretches of as many values as there are steps, as sample paths."""

    def predict(contexts: np.ndarray, steps: int) -> Scored:
        return Scored(samples=contexts[:, contexts.shape[1] - paths * steps :].reshape(len(contexts), paths, steps))

    return predict


@register("past_quantiles")
def past_quantiles(levels: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> Scorer:
    """Quantiles of the context for every step."""

    def predict(contexts: np.ndarray, steps: int) -> Scored:
        found = np.quantile(contexts, levels, axis=1).T
        return Scored(quantiles=np.repeat(found[:, :, None], steps, axis=2), levels=tuple(levels))

    return predict


def _nested(values: np.ndarray) -> pa.Array:
    """An Arrow list (of lists) of the trailing axes."""
    out: pa.Array = pa.array(values.reshape(-1), pa.float64())
    for width, count in zip(values.shape[:0:-1], [int(np.prod(values.shape[: i + 1])) for i in range(values.ndim - 2, -1, -1)], strict=True):
        out = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * width, pa.int32()), out)
    return out


def predicted(scorer: Scorer, contexts: np.ndarray, steps: int, batch_bytes: int = BATCH_BYTES) -> list[Scored]:
    at_once = max(1, batch_bytes // (8 * contexts.shape[1]))
    return [scorer(contexts[i : i + at_once], steps).complete() for i in range(0, len(contexts), at_once)]


def arrow_columns(scored: list[Scored], samples: bool) -> list[pa.Array]:
    columns = [_nested(np.concatenate([np.asarray(getattr(s, f), float) for s in scored])) for f in ("point", "lower", "upper")]
    if samples:
        has = all(s.samples is not None for s in scored)
        n = len(columns[0])
        columns.append(_nested(np.concatenate([np.asarray(s.samples, float) for s in scored])) if has else pa.nulls(n, pa.list_(pa.list_(pa.float64()))))
    return columns


def score(df: DataFrame, scorer: str, horizon: int = 1, length: int = 512, column: str = "rv", size: int = SIZE, samples: bool = False, stretch=None, **options) -> DataFrame:
    """Forecasts of a registered scorer for each row with `length` rows before it: symbol, date, `actual` (mean of the rows from
    the present one on, over those that are left), `point`, `lower`, `upper` (arrays by step), with `samples` also
    those (array of paths, null if the scorer has none), and `forecast`, the mean of the point path.
    """
    size = max(size, length, horizon)
    rows = positions(observed(df, column).select("symbol", "date", F.col(column).cast("double").alias("value")), stretch=stretch)
    blocks = with_halo(rows, length, horizon - 1, size)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("symbol", "date")}
    schema = f"symbol {kinds['symbol']}, date {kinds['date']}, actual double, point array<double>, lower array<double>, upper array<double>" + (", samples array<array<double>>" if samples else "")

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        values, pos = block.column("value").to_numpy(), block.column("pos").to_numpy()
        own = np.flatnonzero((pos // size == block.column("block")[0].as_py()) & (pos >= length))
        names = ["symbol", "date", "actual", "point", "lower", "upper", *(["samples"] if samples else [])]
        if not len(own):
            lists = [pa.nulls(0, pa.list_(pa.float64()))] * 3 + [pa.nulls(0, pa.list_(pa.list_(pa.float64())))] * samples
            return pa.Table.from_arrays([*block.select(["symbol", "date"]).slice(0, 0).columns, pa.nulls(0, pa.float64()), *lists], names=names)
        first, end = int(own[0]), int(own[-1]) + 1
        contexts = np.lib.stride_tricks.sliding_window_view(values, length)[first - length : end - length]
        scored = predicted(get_scorer(scorer, **options), contexts, horizon)
        upto = np.concatenate([[0.0], np.cumsum(values[first:])])
        ahead = np.minimum(np.arange(end - first) + horizon, len(values) - first)
        actual = values[first:end] if horizon == 1 else (upto[ahead] - upto[: end - first]) / (ahead - np.arange(end - first))
        kept = block.slice(first, end - first)
        return pa.Table.from_arrays([kept.column("symbol"), kept.column("date"), pa.array(actual), *arrow_columns(scored, samples)], names=names)

    out = blocks.groupBy("symbol", "block").applyInArrow(run, schema)
    mean = F.aggregate("point", F.lit(0.0), lambda a, x: a + x, lambda a: a / horizon)
    return out.withColumn("forecast", mean)
