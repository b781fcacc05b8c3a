"""ARMA models by exact Gaussian likelihood.

A series is an array of at most a few hundred values, one row per symbol and fold; its refits are
beginnings of that array, so no row is copied for them. A worker takes many series at once:
every fit and start is a lane of numpy arrays, and one Kalman recursion over time serves all lanes.

The likelihood is that of the stationary model. Mean and variance are profiled out: the filter
runs over the values and over ones with the same gains, so the mean is a weighted least-squares
estimate. What is left is a sum of squares of n scaled innovations, minimised by
Gauss-Newton steps with damping over the angles of partial autocorrelations, which hold the model
stationary and invertible. Each fit begins at a two-stage regression estimate and at the likeliest points of a
grid, and keeps the most likely end: a likelihood with many optima may have a better one that no
start leads to. Where that has not settled within `MOST_STEPS`, an AR(1) takes its place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspan.functions.numeric import clip_low
from volspan.operators.features import LOG_FLOOR, position, target
from volspan.operators.walk import test_rows, train_rows
from volspan.sources.panel import observed

MOST_STEPS = 200
#: Series in one run of the filter: with starts and derivatives about a hundred lanes each.
LANE_ROWS = 64
#: The search ends where a step would lessen the sum of squares by a smaller share, or where
#: so many steps on end did not lessen it by that share (on the boundary).
TOLERANCE, IDLE_STEPS = 1e-9, 12
#: Angles of the grid of starts in each direction (two of them where there are more than four directions); starts that are
#: taken, and by how much one of their angles must differ; lanes at once.
GRID, GRID_STARTS, APART, GRID_LANES = (-1.3, -0.65, 0.0, 0.65, 1.3), 4, 0.7, 4096
#: Largest partial autocorrelation.
LIMIT = 1 - 1e-7
#: Half the width of the differences.
STEP = 1e-4
FIT = "n long, const double, ar array<double>, ma array<double>, sigma2 double, log_likelihood double, aic double, bic double, mse double, model string, path array<double>, residuals array<double>"


def from_partial(u: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from angles of partial autocorrelations, a row per lane (Durbin-Levinson).

    An optimum on the boundary, such as a moving average of unit root, is an ordinary one of its angle.
    """
    r = LIMIT * np.sin(u)
    out = np.zeros_like(u)
    for k in range(u.shape[1]):
        out[:, :k] -= r[:, k : k + 1] * out[:, :k][:, ::-1]
        out[:, k] = r[:, k]
    return out


def to_partial(phi: np.ndarray, most: float = 0.97) -> np.ndarray:
    """The angles of one model; partial autocorrelations are held within `most`."""
    a, r = phi.astype(float).copy(), np.zeros(len(phi))
    for k in range(len(phi) - 1, -1, -1):
        r[k] = np.clip(np.nan_to_num(a[k]), -most, most)
        a = (a[:k] + r[k] * a[:k][::-1]) / (1 - r[k] * r[k])
    return np.arcsin(r)


def coefficients(u: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    return from_partial(u[:, :p]), -from_partial(u[:, p:])


class Filtered:
    """Innovations of all lanes: of the values (`vy`), of ones (`v1`), their variances `f`, all (time, lane), and the state at the end of each lane."""

    def __init__(self, y: np.ndarray, n: np.ndarray, phi: np.ndarray, theta: np.ndarray):
        """y: (time, lane), zeros behind the `n` values of a lane."""
        lanes, (p, q) = y.shape[1], (phi.shape[1], theta.shape[1])
        r = max(p, q + 1)
        a = [phi[:, i] if i < p else np.zeros(lanes) for i in range(r)]
        load = [np.ones(lanes)] + [theta[:, i] if i < q else np.zeros(lanes) for i in range(r - 1)]
        cov = self._stationary(a, load, lanes, r)
        ey, e1 = [np.zeros(lanes) for _ in range(r)], [np.zeros(lanes) for _ in range(r)]
        steps = len(y)
        self.vy, self.v1, self.f = np.empty((steps, lanes)), np.empty((steps, lanes)), np.ones((steps, lanes))
        self.ey, self.e1 = np.zeros((r, lanes)), np.zeros((r, lanes))
        gain, settled = None, False
        ends = {int(k) for k in n}
        for t in range(steps):
            vy, v1 = y[t] - ey[0], 1 - e1[0]
            self.vy[t], self.v1[t] = vy, v1
            if not settled:
                f = cov[0][0]
                self.f[t] = f
                moved = [a[i] * cov[0][0] + (cov[i + 1][0] if i + 1 < r else 0) for i in range(r)]
                gain = [m / f for m in moved]
                # transition on the left, then on the right; what the value told is taken away
                left = [[a[i] * cov[0][j] + (cov[i + 1][j] if i + 1 < r else 0) for j in range(r)] for i in range(r)]
                cov = [[left[i][0] * a[j] + (left[i][j + 1] if j + 1 < r else 0) + load[i] * load[j] - gain[i] * moved[j] for j in range(r)] for i in range(r)]
                settled = t % 8 == 7 and bool(np.abs(cov[0][0] - 1).max() < 1e-13)
            ey = [a[i] * ey[0] + (ey[i + 1] if i + 1 < r else 0) + gain[i] * vy for i in range(r)]
            e1 = [a[i] * e1[0] + (e1[i + 1] if i + 1 < r else 0) + gain[i] * v1 for i in range(r)]
            if t + 1 in ends:
                here = n == t + 1
                for i in range(r):
                    self.ey[i, here], self.e1[i, here] = ey[i][here], e1[i][here]
        inside = np.arange(steps)[:, None] < n
        weight = inside / self.f
        self.mean = (weight * self.vy * self.v1).sum(0) / (weight * self.v1 * self.v1).sum(0)
        self.v = np.where(inside, self.vy - self.mean * self.v1, 0.0)
        self.log_f = np.where(inside, np.log(self.f), 0.0).sum(0)
        self.sigma2 = (self.v * self.v / self.f).sum(0) / n
        self.phi, self.n = a, n

    @staticmethod
    def _stationary(a: list, load: list, lanes: int, r: int) -> list:
        """The covariance of the state before the first value: P = A P A' + load load'."""
        move = np.zeros((lanes, r, r))
        for i in range(r):
            move[:, i, 0] += a[i]
            if i + 1 < r:
                move[:, i, i + 1] += 1
        both = np.einsum("lij,lkm->likjm", move, move).reshape(lanes, r * r, r * r)
        noise = np.stack([load[i] * load[j] for i in range(r) for j in range(r)], axis=1)
        p = np.linalg.solve(np.eye(r * r) - both, noise[..., None])[..., 0]
        return [[p[:, i * r + j] for j in range(r)] for i in range(r)]

    def scaled(self) -> np.ndarray:
        """Values whose sum of squares, as a function of the coefficients, falls as the likelihood grows."""
        return self.v / np.sqrt(self.f) * np.exp(self.log_f / (2 * self.n))

    def log_likelihood(self) -> np.ndarray:
        return -0.5 * self.n * (np.log(2 * np.pi * self.sigma2) + 1) - 0.5 * self.log_f

    def path(self, steps: int) -> np.ndarray:
        """Forecasts of the next values, (lane, step)."""
        state = self.ey - self.mean * self.e1
        out = np.empty((len(self.n), steps))
        for s in range(steps):
            out[:, s] = self.mean + state[0]
            state = np.stack([self.phi[i] * state[0] + (state[i + 1] if i + 1 < len(state) else 0) for i in range(len(state))])
        return out


def two_stage(y: np.ndarray, p: int, q: int, long_ar: int = 6) -> np.ndarray:
    """Start of one fit: a long autoregression, then lags and lagged residuals."""
    x = y - y.mean()
    lags = lambda z, k, at: np.column_stack([z[at - i : len(z) - i] for i in range(1, k + 1)])
    long = max(long_ar, p + q)
    e = np.zeros(len(x))
    e[long:] = x[long:] - lags(x, long, long) @ np.linalg.lstsq(lags(x, long, long), x[long:], rcond=None)[0]
    at = long + max(p, q)
    columns = [c for c in (lags(x, p, at) if p else None, lags(e, q, at) if q else None) if c is not None]
    b = np.linalg.lstsq(np.hstack(columns), x[at:], rcond=None)[0]
    return np.concatenate([to_partial(b[:p]), to_partial(-b[p:])])


def padded(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, series) less their means, zeros behind shorter ones, and the lengths."""
    n = np.array([len(y) for y in series])
    y = np.zeros((n.max(), len(series)))
    for i, s in enumerate(series):
        y[: len(s), i] = s - s.mean()
    return y, n


def starts(series: list[np.ndarray], p: int, q: int, most: int = GRID_STARTS) -> list[tuple[int, np.ndarray]]:
    """(series, angles): the two-stage estimate of each, and the `most` likeliest points of a grid that lie apart."""
    k = p + q
    grid = np.stack(np.meshgrid(*[np.array(GRID if k <= 4 else GRID[1::2])] * k, indexing="ij"), -1).reshape(-1, k)
    out = [(i, two_stage(y, p, q)) for i, y in enumerate(series)]
    at_once = max(1, GRID_LANES // len(grid))
    for first in range(0, len(series), at_once):
        y, n = padded(series[first : first + at_once])
        own = np.repeat(np.arange(y.shape[1]), len(grid))
        with np.errstate(all="ignore"):
            cost = (Filtered(y[:, own], n[own], *coefficients(np.tile(grid, (y.shape[1], 1)), p)).scaled() ** 2).sum(0).reshape(-1, len(grid))
        for i, costs in enumerate(np.where(np.isfinite(cost), cost, np.inf)):
            taken: list[np.ndarray] = []
            for point in np.argsort(costs, kind="stable"):
                if len(taken) < most and all(np.abs(grid[point] - x).max() > APART for x in taken):
                    taken.append(grid[point])
            out += [(first + i, x) for x in taken]
    return out


def maximise(series: list[np.ndarray], p: int, q: int, most_steps: int = MOST_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """The angles of the most likely model of each series, and whether they settled."""
    k = p + q
    begun = starts(series, p, q)
    owner, u = np.array([i for i, _ in begun]), np.array([x for _, x in begun])
    y, n = padded(series)

    def scaled(lanes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Residuals (lane, time), their derivatives (lane, angle, time), sums of squares, and half of their second derivatives (lane, angle)."""
        wide = 2 * k + 1
        moved = np.repeat(at, wide, axis=0)
        for j in range(k):
            moved[2 * j + 1 :: wide, j] += STEP
            moved[2 * j + 2 :: wide, j] -= STEP
        own = np.repeat(owner[lanes], wide)
        with np.errstate(all="ignore"):
            e = Filtered(y[:, own], n[own], *coefficients(moved, p)).scaled().T.reshape(len(lanes), wide, -1)
            sums = (e * e).sum(2)
        return e[:, 0], (e[:, 1::2] - e[:, 2::2]) / (2 * STEP), sums[:, 0], (sums[:, 1::2] + sums[:, 2::2] - 2 * sums[:, :1]) / (2 * STEP * STEP)

    u = u.astype(float)
    lanes = np.arange(len(begun))
    e, slope, cost, bend = scaled(lanes, u)

    def descend(lanes: np.ndarray, tolerance: float, most: int) -> np.ndarray:
        """Damped steps of these lanes; tells which have settled."""
        damp, settled, idle = np.full(len(begun), 1e-3), np.zeros(len(begun), bool), np.zeros(len(begun), int)
        for tried in range(most):
            live = lanes[~settled[lanes] & np.isfinite(cost[lanes])]
            if not len(live):
                break
            inner = np.einsum("lat,lbt->lab", slope[live], slope[live])
            # on the boundary the slope vanishes, but not the bend of the sum of squares
            diagonal = np.maximum(np.einsum("laa->la", inner), np.nan_to_num(bend[live]))
            inner = inner * (1 - np.eye(k)) + np.eye(k) * diagonal[:, None, :]
            held = np.eye(k) * (diagonal + 1e-9 * cost[live][:, None])[:, None, :]
            down = np.einsum("lat,lt->la", slope[live], e[live])
            # what a step that is hardly damped would gain, to first order
            ahead = np.einsum("la,la->l", down, np.linalg.solve(inner + 1e-7 * held, down[..., None])[..., 0])
            move = np.clip(-np.linalg.solve(inner + damp[live][:, None, None] * held, down[..., None])[..., 0], -1, 1)
            e_new, slope_new, cost_new, bend_new = scaled(live, u[live] + move)
            better = np.isfinite(cost_new) & (cost_new <= cost[live])
            idle[live] = np.where(better & (cost[live] - cost_new > tolerance * cost[live]), 0, idle[live] + 1)
            settled[live[(ahead < tolerance * cost[live]) | (idle[live] == IDLE_STEPS)]] = True
            if tried >= 10:  # lanes that fall far short of another start of their series go no further
                least = np.full(len(series), np.inf)
                np.minimum.at(least, owner, np.where(np.isfinite(cost), cost, np.inf))
                settled[live[cost[live] - 30 * ahead > least[owner[live]] * (1 + 1e-7)]] = True
            took = live[better]
            u[took], e[took], slope[took], cost[took], bend[took] = u[took] + move[better], e_new[better], slope_new[better], cost_new[better], bend_new[better]
            damp[live] = np.where(better, np.maximum(damp[live] / 5, 1e-9), damp[live] * 6)
        return settled

    settled = descend(lanes, TOLERANCE, most_steps)
    best = np.full(len(series), -1)
    for lane in np.argsort(np.where(np.isfinite(cost), cost, np.inf), kind="stable"):
        if best[owner[lane]] < 0:
            best[owner[lane]] = lane
    settled = settled[best] & np.isfinite(cost[best])
    descend(best[settled], 1e-4 * TOLERANCE, 20)
    return u[best], settled


def fit_series(series: list[np.ndarray], p: int, q: int, steps: int = 1, most_steps: int = MOST_STEPS) -> list[dict]:
    """A dict of the fields of `FIT` for each series; values of no variance have a mean only."""
    out: list[dict | None] = [None] * len(series)
    todo = [i for i, y in enumerate(series) if np.ptp(y) > 1e-9 * max(1.0, np.abs(y).max()) and len(y) > 2 * max(6, p + q) + 4]
    for i in set(range(len(series))) - set(todo):
        y = series[i]
        out[i] = {"n": len(y), "const": float(y.mean()), "ar": [], "ma": [], "sigma2": 0.0, "log_likelihood": None, "aic": None, "bic": None, "mse": float(np.var(y)), "model": "mean", "path": [float(y.mean())] * steps, "residuals": (y - y.mean()).tolist()}
    for p_, q_ in ((p, q), (1, 0)):
        if not todo:
            break
        held = [series[i] for i in todo]
        u, settled = maximise(held, p_, q_, most_steps)
        (y, n), shift = padded(held), np.array([y.mean() for y in held])
        phi, theta = coefficients(u, p_)
        done = Filtered(y, n, phi, theta)
        llf, path, mse = done.log_likelihood(), done.path(steps) + shift[:, None], (done.v**2).sum(0) / n
        failed = []
        for j, i in enumerate(todo):
            if not (settled[j] and np.isfinite(llf[j])) and (p_, q_) != (1, 0):
                failed.append(i)
                continue
            count = p_ + q_ + 2
            out[i] = {
                "n": int(n[j]), "const": float(done.mean[j] + shift[j]), "ar": phi[j].tolist(), "ma": theta[j].tolist(), "sigma2": float(done.sigma2[j]), "log_likelihood": float(llf[j]),
                "aic": float(2 * count - 2 * llf[j]), "bic": float(count * np.log(n[j]) - 2 * llf[j]), "mse": float(mse[j]), "model": f"ARMA({p_},{q_})", "path": path[j].tolist(), "residuals": done.v[: n[j], j].tolist(),
            }
        todo = failed
    return out


def _spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Small rows that take long: as many tasks as the session shuffles to, which adaptive execution does not merge."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def log_series(df: DataFrame) -> DataFrame:
    """Rows with rv: symbol, date, pos, rv and y, its floored logarithm."""
    rows = observed(df, "rv").withColumn("pos", position())
    return rows.select("symbol", "date", "pos", "rv", F.ln(clip_low(F.col("rv"), LOG_FLOOR)).alias("y"))


def fit_arrays(arrays: DataFrame, p: int, q: int, refits: Sequence[int] | None = None, least: int = 50, steps: int = 1, residuals: bool = True) -> DataFrame:
    """The columns of `arrays` but `y`, then `refit` and the fields of `FIT`: a row for every refit of each array `y`.

    `refits` are the lengths of the beginnings that are fitted, the refit's number being their place;
    those longer than the array are left out, and so are beginnings shorter than `least`. None fits the whole array.
    """
    kept = [c for c in arrays.columns if c != "y"]
    schema = ", ".join(f"`{c}` {arrays.schema[c].dataType.simpleString()}" for c in kept) + f", refit long, {FIT}"
    names = [c.split()[0] for c in FIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, LANE_ROWS):
                part = batch.slice(start, LANE_ROWS)
                held = [np.asarray(y, float) for y in part.column(len(kept)).to_pylist()]
                wanted = [(i, r, y[:n]) for i, y in enumerate(held) for r, n in enumerate(refits or [len(y)]) if n <= len(y) and n >= least]
                made = fit_series([y for *_, y in wanted], p, q, steps) if wanted else []
                rows = part.select(kept).take(pa.array([i for i, *_ in wanted], pa.int32()))
                columns = [pa.array([r for _, r, _ in wanted], pa.int64())]
                types = [pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 2, *[pa.float64()] * 5, pa.string(), *[pa.list_(pa.float64())] * 2]
                for c, t in zip(names, types, strict=True):
                    columns.append(pa.array([None if c == "residuals" and not residuals else m[c] for m in made], t))
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*kept, "refit", *names])

    return arrays.select(*kept, "y").mapInArrow(run, schema)


def _arrays(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values of each key in order of position, and the first position."""
    held = _spread(rows.select(*keys, "pos", "y"), keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "y"))).alias("held"))
    return held.select(*keys, F.get("held", F.lit(0))["pos"].alias("first_pos"), F.col("held.y").alias("y"))


def arma_fit(df: DataFrame, p: int = 2, q: int = 2, steps: int = 1, least: int = 50) -> DataFrame:
    """One fit of the whole log variance of each symbol: symbol, `n`, `const`, `ar`, `ma`, `sigma2`, `log_likelihood`, `aic`, `bic`,
    `mse`, `model`, `path` (log forecasts of the next `steps`) and `residuals` (in order of date, the first at `first_pos`)."""
    return fit_arrays(_arrays(log_series(df), ["symbol"]), p, q, least=least, steps=steps).drop("refit")


def residual_rows(df: DataFrame, fits: DataFrame) -> DataFrame:
    """The residuals of `arma_fit` as rows: symbol, date, residual."""
    rows = fits.select("symbol", "first_pos", F.posexplode("residuals").alias("i", "residual")).select("symbol", (F.col("first_pos") + F.col("i")).alias("pos"), "residual")
    return log_series(df).select("symbol", "date", "pos").join(rows, ["symbol", "pos"]).select("symbol", "date", "residual")


def arma_ml_walk_forward(df: DataFrame, horizon: int = 1, train: int = 252, test: int = 126, step: int = 126, every: int = 22, p: int = 2, q: int = 2, least: int = 50) -> DataFrame:
    """Exact-likelihood ARMA(p, q) forecasts of variance: symbol, date, fold, refit, actual, forecast, and of the fit
    `model`, `log_likelihood`, `aic`, `bic`.

    Folds and refits are those of `arma.arma_walk_forward`: a refit every `every` test rows on the fold's rows so far, whose
    first step, exp(log forecast + mse / 2), stands for all rows up to the next refit. A fold's rows are
    one array, of which the refits are beginnings.
    """
    rows = log_series(df)
    folds = _arrays(train_rows(rows, train + test, step), ["symbol", "fold"])
    fits = fit_arrays(folds, p, q, refits=[train + r * every for r in range(-(-test // every))], least=least, residuals=False)
    made = fits.select("symbol", "fold", "refit", F.exp(F.get("path", F.lit(0)) + F.col("mse") / 2).alias("forecast"), "model", "log_likelihood", "aic", "bic")
    tested = test_rows(rows.withColumn("actual", target("rv", horizon)), train, test, step).where("actual is not null")
    tested = tested.withColumn("refit", F.floor((F.col("pos") - F.col("fold") * step - train) / every))
    return tested.join(made, ["symbol", "fold", "refit"]).select("symbol", "date", "fold", "refit", "actual", "forecast", "model", "log_likelihood", "aic", "bic")
