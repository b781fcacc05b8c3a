"""Panels from tick tables: measures per symbol and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def realized_measures(ticks: DataFrame, order: list[str]) -> DataFrame:
    """Daily measures from ticks (symbol, date, log price `p`, order columns).

    A return is the difference to the symbol's previous tick; bipower variation pairs
    neighbouring returns of a day. Ticks are sorted within symbol and day only: the return over
    night comes from the daily last prices, which are few, and is added to the day's sums.
    """
    by_day = Window.partitionBy("symbol", "date").orderBy(*order)
    last, before = F.lag("p").over(by_day), F.lag("p", 2).over(by_day)  # one pass of the window for both returns
    r = ticks.withColumns({"r": F.col("p") - last, "before": F.abs(last - before), "place": F.row_number().over(by_day)})
    square = F.col("r") * F.col("r")
    day = r.groupBy("symbol", "date").agg(
        F.min_by("p", "place").alias("first"),
        F.max_by("p", "place").alias("last"),
        F.max(F.when(F.col("place") == 2, F.abs("r"))).alias("second"),
        F.count("r").alias("n"),
        *[F.coalesce(e, F.lit(0.0)).alias(c) for c, e in {
            "rv": F.sum(square), "bv": F.sum(F.abs("r") * F.col("before")), "good": F.sum(F.when(F.col("r") > 0, square)),
            "bad": F.sum(F.when(F.col("r") < 0, square)), "fourth": F.sum(square * square),
        }.items()],
    )
    night = F.col("first") - F.lag("last").over(Window.partitionBy("symbol").orderBy("date"))
    day = day.withColumn("night", night)
    known, night = F.col("night").isNotNull(), F.coalesce("night", F.lit(0.0))
    day = day.withColumns({"n": F.col("n") + known.cast("long"), "square": night * night})
    return day.where("n > 0").select(
        "date",
        "symbol",
        (F.col("rv") + F.col("square")).alias("rv"),
        (F.lit(3.141592653589793 / 2) * (F.col("bv") + F.abs(night) * F.coalesce("second", F.lit(0.0)))).alias("bv"),
        (F.col("good") + F.when(night > 0, F.col("square")).otherwise(0.0)).alias("good"),
        (F.col("bad") + F.when(night < 0, F.col("square")).otherwise(0.0)).alias("bad"),
        (F.col("n") / F.lit(3.0) * (F.col("fourth") + F.col("square") * F.col("square"))).alias("rq"),
    )


def lineitem_ticks(lineitem: DataFrame, symbol: Column) -> DataFrame:
    """Every order line is a tick whose unit price plays the price."""
    return lineitem.select(
        symbol.alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        (0.01 * F.ln(F.col("l_extendedprice") / F.col("l_quantity"))).alias("p"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


TICK_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
