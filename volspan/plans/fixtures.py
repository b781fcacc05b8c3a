"""Panels, forecasts and dimensions that the registered queries are applied to, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspan.operators.features import position, rolling_mean, target
from volspan.session import new_path
from volspan.sources import panel as panels
from volspan.sources.ticks import TICK_ORDER, lineitem_ticks, realized_measures

#: Rolling means that stand in for models: name -> rows; all start at row 66.
MODELS = {"last": 1, "roll_22": 22, "roll_5": 5, "roll_66": 66}
WARM_UP = 66
#: Suppliers up to which they are broadcast to the order lines; beyond, Spark chooses.
BROADCAST_ROWS = 1_000_000
HORIZONS = (1, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_panel(ticks: DataFrame) -> DataFrame:
    """The panel of ticks, written once: queries read it several times, and each reading would shuffle and sort all ticks anew."""
    panel = panels.with_jump(panels.with_log(realized_measures(ticks, TICK_ORDER)))
    path = new_path(ticks.sparkSession, "measures")
    panel.write.parquet(path)
    return ticks.sparkSession.read.schema(panel.schema).parquet(path)


def panel3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol per return flag."""
    return written_panel(lineitem_ticks(table(spark, sf_dir, "lineitem"), F.col("l_returnflag")))


def panel5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol per region of the supplier."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    few = suppliers.count() <= BROADCAST_ROWS
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    lines = lines.join(F.broadcast(suppliers) if few else suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return written_panel(lineitem_ticks(lines, F.col("r_name")))


def panel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly ticks of events, as (symbol, bucket, ticks, value)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("ticks"), F.avg(F.ln(1 + F.col("value"))).alias("value"))


#: Fifteen of them.
MODELS15 = {f"m_{n}": n for n in (4 * k + 2 for k in range(15))}


def rolling_forecasts(panel: DataFrame, horizons: tuple[int, ...] = HORIZONS, models: dict[str, int] = MODELS) -> DataFrame:
    """Long forecasts of the rolling means: symbol, horizon, model, date, actual, forecast."""
    x = panel.withColumn("pos", position()).withColumns({m: rolling_mean("rv", n, 1) for m, n in models.items()} | {f"actual_{h}": target("rv", h) for h in horizons})
    x = x.where(F.col("pos") >= WARM_UP)
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model"), F.col(f"actual_{h}").alias("actual"), F.col(m).alias("forecast")) for h in horizons for m in models])
    return x.select("symbol", "date", F.explode(rows).alias("r")).select("symbol", "r.horizon", "r.model", "date", "r.actual", "r.forecast").where("actual is not null and forecast is not null")


CLASSES = {"AFRICA": "stocks", "AMERICA": "stocks", "ASIA": "stocks", "EUROPE": "fx", "MIDDLE EAST": "futures"}


def dim_asset(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLASSES.items()), "symbol string, asset_class string")


def dim_model(spark: SparkSession) -> DataFrame:
    """Fixed order and display names of the models."""
    rows = [("last", "Last value", "naive", 0), ("roll_5", "Week mean", "econ", 1), ("roll_22", "Month mean", "econ", 2), ("roll_66", "Quarter mean", "econ", 3)]
    return spark.createDataFrame(rows, "model string, display string, family string, ord int")
