"""Pieces of the oracle SQL: the same panels and forecasts, and the tests by other algorithms."""

from __future__ import annotations

K = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

_MEASURES = f"""
r_ AS (SELECT *, p - lag(p) OVER (PARTITION BY symbol ORDER BY date, {K}) AS r FROM t_),
s_ AS (SELECT *, lag(abs(r)) OVER (PARTITION BY symbol, date ORDER BY {K}) AS ra FROM r_ WHERE r IS NOT NULL),
m_ AS (SELECT date, symbol, sum(r * r) AS rv, coalesce(pi() / 2 * sum(abs(r) * ra), 0) AS bv, sum(CASE WHEN r > 0 THEN r * r ELSE 0 END) AS good,
              sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) AS bad, count(*) / 3.0::DOUBLE * sum(r * r * r * r) AS rq FROM s_ GROUP BY date, symbol),
panel AS (SELECT *, ln(rv) AS log_rv, greatest(rv - bv, 0) AS jump, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos FROM m_)"""

PANEL3 = f"t_ AS (SELECT l_returnflag AS symbol, cast(l_shipdate AS DATE) AS date, 0.01 * ln(l_extendedprice / l_quantity) AS p, {K} FROM lineitem)," + _MEASURES
PANEL5 = (
    f"t_ AS (SELECT r_name AS symbol, cast(l_shipdate AS DATE) AS date, 0.01 * ln(l_extendedprice / l_quantity) AS p, {K} FROM lineitem "
    "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)," + _MEASURES
)


def mean_back(n: int, column: str = "rv", shift: int = 1) -> str:
    w = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)" if shift else f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {w} = {n} THEN avg({column}) OVER {w} END"


def mean_ahead(h: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)"
    return "rv" if h == 1 else f"CASE WHEN count(rv) OVER {w} = {h} THEN avg(rv) OVER {w} END"


_MODELS = {"last": 1, "roll_22": 22, "roll_5": 5, "roll_66": 66}
FORECASTS = (
    "wide_ AS (SELECT symbol, date, pos, " + ", ".join(f"{mean_back(n)} AS {m}" for m, n in _MODELS.items()) + f", {mean_ahead(1)} AS a1, {mean_ahead(5)} AS a5 FROM panel),\n"
    "fc AS (" + " UNION ALL ".join(f"SELECT symbol, {h} AS horizon, '{m}' AS model, date, a{h} AS actual, {m} AS forecast FROM wide_ WHERE pos >= 66 AND a{h} IS NOT NULL AND {m} IS NOT NULL" for h in (1, 5) for m in _MODELS) + ")"
)
_WIDE = tuple(4 * k + 2 for k in range(15))
FORECASTS15 = (
    "wide_ AS (SELECT symbol, date, pos, " + ", ".join(f"{mean_back(n)} AS m_{n}" for n in _WIDE) + f", {mean_ahead(22)} AS actual FROM panel),\n"
    "fc AS (" + " UNION ALL ".join(f"SELECT symbol, 22 AS horizon, 'm_{n}' AS model, date, actual, m_{n} AS forecast FROM wide_ WHERE pos >= 66 AND actual IS NOT NULL AND m_{n} IS NOT NULL" for n in _WIDE) + ")"
)
F3, F5 = PANEL3 + ",\n" + FORECASTS, PANEL5 + ",\n" + FORECASTS

QL = "CASE WHEN actual > 0 AND forecast > 0 THEN actual / forecast - ln(actual / forecast) - 1 END"
QF = "greatest(actual / greatest(forecast, 1e-10), 1e-10) - ln(greatest(actual / greatest(forecast, 1e-10), 1e-10)) - 1"
AGG = f"avg((actual - forecast) * (actual - forecast)) AS MSE, avg(abs(actual - forecast)) AS MAE, avg({QL}) AS QLIKE, CASE WHEN var_pop(actual) = 0 THEN 0 ELSE 1 - sum((actual - forecast) * (actual - forecast)) / (var_pop(actual) * count(*)) END AS R2OOS"
METRICS = f"met AS (SELECT symbol, horizon, model, {AGG}, count(*) AS n_obs FROM fc GROUP BY symbol, horizon, model)"
LOSS = f"loss AS (SELECT symbol, horizon, model, date, {QF} AS loss FROM fc)"


def cdf(x: str) -> str:
    """The standard normal distribution function: the same published approximation."""
    z = f"abs({x})"

    def poly(c: tuple[float, ...]) -> str:
        out = repr(c[0])
        for v in c[1:]:
            out = f"({out} * {z} + {v!r})"
        return out

    top = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    low = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
    far = f"({z} + 0.65)"
    for k in (4, 3, 2, 1):
        far = f"({z} + {k}.0 / {far})"
    e = f"exp(-({z}) * ({z}) / 2)"
    tail = f"CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < 7.07106781186547 THEN {e} * {poly(top)} / {poly(low)} ELSE {e} / {far} / 2.506628274631 END"
    return f"(CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END)"


def features(model: str, h: int) -> str:
    """CTE feat(symbol, date, x1.., actual, y, pos): regressors and targets, complete rows numbered."""
    d, w, m = "lag(rv, 1) OVER (PARTITION BY symbol ORDER BY date)", mean_back(5), mean_back(22)
    lg = lambda x: f"ln(greatest({x}, 1e-10))"
    x = {
        "HAR": [d, w, m],
        "HAR_J": [d, w, m, "lag(jump, 1) OVER (PARTITION BY symbol ORDER BY date)"],
        "HAR_RS": [e for c in ("good", "bad") for e in (f"lag({c}, 1) OVER (PARTITION BY symbol ORDER BY date)", mean_back(5, c), mean_back(22, c))],
        "HARQ": [d, w, m, "lag(rv, 1) OVER (PARTITION BY symbol ORDER BY date) * sqrt(lag(rq, 1) OVER (PARTITION BY symbol ORDER BY date))"],
        "Log_HAR": [d, w, m],
    }[model]
    inner = "SELECT symbol, date, " + ", ".join(f"{e} AS x{i}" for i, e in enumerate(x)) + f", {mean_ahead(h)} AS actual FROM panel"
    names = [f"{lg(f'x{i}')} AS x{i}" if model == "Log_HAR" else f"x{i}" for i in range(len(x))]
    y = lg("actual") if model == "Log_HAR" else "actual"
    keep = " AND ".join([f"x{i} IS NOT NULL" for i in range(len(x))] + ["actual IS NOT NULL"])
    return f"raw_ AS ({inner}),\nfeat AS (SELECT symbol, date, {', '.join(names)}, actual, {y} AS y, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos FROM raw_ WHERE {keep})"


N_X = {"HAR": 3, "HAR_J": 4, "HAR_RS": 6, "HARQ": 4, "Log_HAR": 3}


def orthogonal(k: int, rows: str, keys: str, tag: str = "") -> str:
    """CTEs o0..ok (their names after `tag`): fitted values by sequential orthogonalisation of x0.. on the rows marked `tr`."""
    out = [f"{tag}o0 AS (SELECT *, avg(y) FILTER (WHERE tr) OVER (PARTITION BY {keys}) AS fit FROM {rows})"]
    for j in range(k):
        w = f"OVER (PARTITION BY {keys})"
        part = "".join(f" - sum(x{j} * z{i}) FILTER (WHERE tr) {w} / nullif(sum(z{i} * z{i}) FILTER (WHERE tr) {w}, 0) * z{i}" for i in range(j))
        out.append(f"{tag}q{j} AS (SELECT *, x{j} - avg(x{j}) FILTER (WHERE tr) {w}{part} AS z{j} FROM {tag}o{j})")
        out.append(f"{tag}o{j + 1} AS (SELECT * REPLACE (fit + sum(y * z{j}) FILTER (WHERE tr) {w} / nullif(sum(z{j} * z{j}) FILTER (WHERE tr) {w}, 0) * z{j} AS fit) FROM {tag}q{j})")
    return ",\n".join(out)


def walk(model: str, h: int, train: int = 252, test: int = 126) -> str:
    """CTE wf(symbol, date, fold, actual, forecast) for folds that step by `test`."""
    k = N_X[model]
    s2 = f"sum((y - fit) * (y - fit)) FILTER (WHERE tr) OVER (PARTITION BY symbol, fold) / (count(*) FILTER (WHERE tr) OVER (PARTITION BY symbol, fold) - {k + 1})"
    f = f"exp(fit + {s2} / 2)" if model == "Log_HAR" else "fit"
    return (
        features(model, h)
        + f""",
folds_ AS (SELECT symbol, unnest(range(0, cast(floor((count(*) - {train} - 1) / {test}) AS BIGINT) + 1)) AS fold FROM feat GROUP BY symbol HAVING count(*) > {train}),
j_ AS (SELECT feat.*, fold, pos < fold * {test} + {train} AS tr FROM feat JOIN folds_ USING (symbol) WHERE pos >= fold * {test} AND pos < fold * {test} + {train + test}),
{orthogonal(k, "j_", "symbol, fold")},
p_ AS (SELECT *, {f} AS value FROM o{k}),
wf AS (SELECT symbol, date, fold, actual, greatest(value, 1e-6) AS forecast FROM p_ WHERE NOT tr)"""
    )
