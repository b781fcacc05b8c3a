"""Exact quantiles of groups of any size by counting rounds.

`percentile` holds every distinct value of a group in one task. Here a wanted rank of a group has an interval
of values that holds it, at first all of them. A round counts the values of each interval in `buckets` parts, with their
least and largest value, which combines before the shuffle; the part in which the rank falls is the next
interval. An interval of one value is the answer. A round narrows intervals by the number of parts, by logarithms
where they span magnitudes, so a few do; there is no cap, as every round leaves out values. What a task holds is a row per part, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volspan.functions.numeric import finite
from volspan.session import drop_paths, new_path

BUCKETS = 1024
#: Above minus the logarithm of the smallest double.
LEAST_LOG = 746.0


def exact_quantiles(df: DataFrame, keys: Sequence[str], column: str, levels: Sequence[float], buckets: int = BUCKETS) -> DataFrame:
    """(keys, `level`, `value`): quantiles with linear interpolation between neighbours, of the finite values of each group.

    Groups without one, and rows with a null key, are left out. The rows are read once a round.
    """
    spark, keys = df.sparkSession, list(keys)
    rows = df.select(*keys, F.col(column).cast("double").alias("value")).where(finite(F.col("value"))).dropna(subset=keys)
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.col("level") * (F.col("n") - 1)
    wanted = ends.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumns({"rank": F.floor(place), "share": place - F.floor(place)})
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array("rank", F.least(F.col("rank") + 1, F.col("n") - 1)))))
    state = wanted.select(*keys, "level", "share", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"))
    path = new_path(spark, "ranks")
    state.write.parquet(path)
    while True:
        state = spark.read.schema(state.schema).parquet(path)
        still = state.where("lo < hi")
        if still.isEmpty():
            break
        spans = still.select(*keys, "lo", "hi").distinct()
        inside = rows.join(spans, keys).where(F.col("value").between(F.col("lo"), F.col("hi")))
        # intervals that span magnitudes are cut by logarithms; half a width is never beyond the largest double
        far = (F.col("lo") <= 0) & (F.col("hi") >= 0) | (F.greatest(F.abs("lo"), F.abs("hi")) > 16 * F.least(F.abs("lo"), F.abs("hi")))
        scale = lambda c: F.when(far, F.signum(c) * (F.coalesce(F.ln(F.abs(c)), F.lit(-LEAST_LOG)) + LEAST_LOG)).otherwise(F.col(c) / 2)
        inside = inside.withColumns({"from lo": scale("value") - scale("lo"), "width": scale("hi") - scale("lo")})
        even = F.least(F.floor(F.col("from lo") / F.col("width") * buckets), F.lit(buckets - 1))
        part = F.when(F.col("width") > 0, even).when(F.col("value") > F.col("lo"), buckets - 1).otherwise(0)
        counted = inside.groupBy(*keys, "lo", "hi", part.alias("part")).agg(F.count("*").alias("held"), F.min("value").alias("least"), F.max("value").alias("most"))
        before = Window.partitionBy(*keys, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("passed", F.coalesce(F.sum("held").over(before), F.lit(0)))
        upto = F.col("below") + F.col("passed")
        narrowed = still.join(counted, [*keys, "lo", "hi"]).where((F.col("rank") >= upto) & (F.col("rank") < upto + F.col("held")))
        state = state.where("lo = hi").unionByName(narrowed.select(*keys, "level", "share", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), upto.alias("below")))
        old, path = path, new_path(spark, "ranks")
        state.write.parquet(path)
        drop_paths(spark, [old])
    value = F.min("lo") + F.first("share") * (F.max("lo") - F.min("lo"))
    return state.groupBy(*keys, "level").agg(value.alias("value"))


def winsorize(df: DataFrame, share: float = 0.995, key: str = "symbol", column: str = "rv") -> DataFrame:
    """Clip a column above its quantile per symbol, of groups of any size; the same values as `panel.winsorize`."""
    top = exact_quantiles(df, [key], column, [share]).select(key, F.col("value").alias("top"))
    return df.join(top, key).withColumn(column, F.when(F.col(column) > F.col("top"), F.col("top")).otherwise(F.col(column))).drop("top")
