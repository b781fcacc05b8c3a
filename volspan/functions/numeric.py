"""Column expressions: guards, rounding, and distribution tails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def non_null(x: Column) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function.

    The argument is bound once, as the value of a lambda: the approximation names it some
    thirty times, and generated code would repeat all that it is made of.
    """
    return F.element_at(F.transform(F.array(x), _normal_cdf), 1)


def _normal_cdf(x: Column) -> Column:
    """Rational approximation in double precision (Hart 1968, as given by West 2005): absolute
    error near 1e-16; a continued fraction beyond |x| = 7.07.
    """
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    # fixed values of the approximation, highest power first
    top = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    low = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

    def poly(coefficients: tuple[float, ...]) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * z + c
        return out

    far = z + 0.65
    for k in (4, 3, 2, 1):
        far = z + F.lit(float(k)) / far
    tail = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, e * poly(top) / poly(low)).otherwise(e / far / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def two_sided_p(t: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(t)))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for whole degrees of freedom of at least 1: a finite sum in the angle arctan(t / sqrt df)."""

    def tail(x: Column) -> Column:
        angle = F.atan2(F.abs(x["t"]), F.sqrt(x["df"]))
        c, s, odd = F.cos(angle), F.sin(angle), x["df"] % 2 == 1
        steps = F.floor((x["df"] - F.when(odd, 3).otherwise(2)) / 2)
        start = F.when(odd, c).otherwise(1.0)
        ratio_ = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        ks = F.when(steps >= 1, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>"))
        total = F.aggregate(
            ks,
            F.struct(start.alias("term"), start.alias("sum")),
            lambda a, k: F.struct((a["term"] * ratio_(k) * c * c).alias("term"), (a["sum"] + a["term"] * ratio_(k) * c * c).alias("sum")),
            lambda a: a["sum"],
        )
        whole = F.when(odd, (angle + F.when(x["df"] > 1, s * total).otherwise(0.0)) * (2 / 3.141592653589793)).otherwise(s * total)
        return F.when(x["df"] >= 1, 1 - whole)

    return F.element_at(F.transform(F.array(F.struct(t.alias("t"), df.cast("long").alias("df"))), tail), 1)


def f2_tail(f: Column, df: Column) -> Column:
    """P(F(2, df) > f), in closed form."""
    return F.pow(1 + 2 * f / df, -df / 2)


def clip_low(x: Column, low: float) -> Column:
    """Clip from below; null stays null (greatest() would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))
