"""Forecast tables on disk: partitioned writes, directory scans, names, and what is still to run."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clean_name(model: Column) -> Column:
    """A model name as it stands in file names."""
    return F.regexp_replace(model, r"[-. ]", "_")


#: What identifies a run.
RUN = ("symbol", "horizon", "model")
SCHEMA = "date date, actual double, forecast double, model string, horizon int, symbol string"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """symbol, horizon, model (its full name), `folder` (the cleaned name), `rows`: the runs whose last write was completed."""
    fs, pattern = _files(spark, f"{path}/_runs/written-*")
    names = "symbol string, horizon int, folder string, model string, rows long, written timestamp"
    if not fs.globStatus(pattern):
        return spark.createDataFrame([], names).drop("written")
    runs = spark.read.schema(names).parquet(f"{path}/_runs/written-*")
    last = F.max_by(F.struct("folder", "rows"), "written").alias("last")
    return runs.groupBy(*RUN).agg(last).select(*RUN, "last.folder", "last.rows")


def write_runs(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A folder per run (model, horizon, symbol), which takes the place of an earlier one: a run written twice has its rows once.

    The runs are listed first, out of sight, and the list is moved to the manifest when the rows are written,
    so a job that ends in between leaves its runs uncommitted. Two names that clean to one raise an error, before anything is
    written, also if one of them is there already.
    """
    spark = df.sparkSession
    named = df.withColumn("folder", clean_name(F.col("model"))).withColumns({"symbol": F.col("symbol").cast("string"), "horizon": F.col("horizon").cast("int")})
    draft, final = (f"{path}/_runs/{state}-{uuid.uuid4().hex}" for state in (".draft", "written"))
    named.groupBy("symbol", "horizon", "folder", "model").agg(F.count("*").alias("rows")).withColumn("written", F.current_timestamp()).write.parquet(draft)
    listed = spark.read.parquet(draft).select("folder", "model").unionByName(committed_runs(spark, path).select("folder", "model"))
    clash = listed.groupBy("folder").agg(F.sort_array(F.collect_set("model")).alias("models")).where(F.size("models") > 1).first()
    fs, source = _files(spark, draft)
    if clash is not None:
        fs.delete(source, True)
        raise ValueError(f"models {', '.join(clash.models)} would share the folder {clash.folder}")
    # one file per run, but for runs so large that Spark splits them
    rows = named.drop("model").withColumnRenamed("folder", "model").hint("rebalance", "model", "horizon", "symbol")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "horizon", "symbol").format(fmt).option("header", True).save(path)
    if not fs.rename(source, _files(spark, final)[1]):
        raise OSError(f"the list of runs could not be moved to {final}")


def write_forecasts(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "runs") -> None:
    """`write_runs`, or with another mode one folder per model and horizon; names are cleaned."""
    if mode == "runs":
        return write_runs(df, path, fmt)
    df.withColumn("model", clean_name(F.col("model"))).write.mode(mode).partitionBy("model", "horizon").format(fmt).option("header", True).save(path)


def scan_forecasts(spark: SparkSession, path: str, models: Sequence[str] | None = None, horizons: Sequence[int] | None = None, fmt: str = "parquet", schema: str = SCHEMA) -> DataFrame:
    """Rows with actual and forecast; filters on model, horizon and symbol prune folders. A schema keeps symbols such as 007 as they are."""
    df = spark.read.format(fmt).option("header", True).schema(schema).load(path)
    if models is not None:
        df = df.where(F.col("model").isin(*models))
    if horizons is not None:
        df = df.where(F.col("horizon").isin(*horizons))
    return df.dropna(subset=["actual", "forecast"])


def scan_forecast_files(spark: SparkSession, path: str, known: DataFrame | None = None, least: int = 0, by_folder: str | None = None) -> DataFrame:
    """CSV files named model_SYMBOL_hN.csv below a folder, identified by their names; other files are left out.

    With `by_folder` the name stands in a folder `<by_folder>=<name>` instead, as partitioned writes leave it.
    `known` (symbol, ...; broadcast up to Spark's own threshold) keeps h = 1 files of those
    symbols only; `least` drops files with fewer rows.
    """
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).schema("date date, actual double, forecast double").csv(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1) if by_folder is None else F.regexp_extract(F.col("_metadata.file_path"), f"{by_folder}=([^/]*)/", 1)
    df = parse_forecast_name(raw.withColumn("name", F.url_decode(stem))).dropna(subset=["actual", "forecast"])
    if known is not None:
        df = df.where("horizon = 1").join(known.select("symbol").distinct(), "symbol", "left_semi")
    if least:
        counted = df.groupBy("name").agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
        df = df.join(counted.select("name"), "name", "left_semi")
    return df.drop("name")


NAME = r"^(.+)_([A-Z]+)_h(\d+)$"


def parse_forecast_name(df: DataFrame, name: str = "name") -> DataFrame:
    """model, symbol and horizon from names like HAR_RS_C_h1; names that don't fit (such as ..._ctx128) go."""
    n = F.col(name)
    return df.where(n.rlike(NAME)).withColumns({"model": F.regexp_extract(n, NAME, 1), "symbol": F.regexp_extract(n, NAME, 2), "horizon": F.regexp_extract(n, NAME, 3).cast("int")})


def parse_forecast_suffix(df: DataFrame, assets: DataFrame, name: str = "name") -> DataFrame:
    """The same by known symbols: what precedes the last _h must end with one of them, the longest wins."""
    n = F.col(name)
    at = F.length(n) - F.instr(F.reverse(n), "h_") - 1
    head = df.where(n.contains("_h")).withColumns({"head": F.substring(n, F.lit(1), at), "tail": F.substring(n, at + 3, F.length(n))}).where(F.col("tail").rlike(r"^\d+$"))
    hit = head.join(assets.select("symbol").distinct(), F.endswith("head", F.concat(F.lit("_"), "symbol")))
    best = hit.groupBy(name, "head", "tail").agg(F.max_by("symbol", F.length("symbol")).alias("symbol"))
    model = F.substring(F.col("head"), F.lit(1), F.length("head") - F.length("symbol") - 1)
    return best.select(name, model.alias("model"), "symbol", F.col("tail").cast("int").alias("horizon"))


def forecast_names(df: DataFrame) -> Column:
    """File stem of a forecast: other context lengths than 512 are tagged."""
    tag = F.when(F.col("context_length") != 512, F.concat(F.lit("_ctx"), F.col("context_length").cast("string"))).otherwise("")
    return F.concat(clean_name(F.col("model")), F.lit("_"), F.col("symbol"), F.lit("_h"), F.col("horizon").cast("string"), tag)


def forecasts_wide(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per symbol, horizon and date: the actual and a column per model."""
    return df.groupBy("symbol", "horizon", "date").pivot("model", list(models)).agg(F.first("forecast")).join(df.groupBy("symbol", "horizon", "date").agg(F.min_by("actual", "model").alias("actual")), ["symbol", "horizon", "date"])


def run_grid(symbols: DataFrame, horizons: Sequence[int], models: Sequence[str]) -> DataFrame:
    """Every symbol, horizon and model: the lists are small and explode beside each symbol."""
    grid = symbols.select("symbol").distinct()
    return grid.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def pending_runs(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Runs of the grid of which no row is written yet."""
    return grid.join(done.select("symbol", "horizon", "model").distinct(), ["symbol", "horizon", "model"], "left_anti")


def pending_in(grid: DataFrame, path: str) -> DataFrame:
    """Runs of the grid that are not committed at a path of `write_runs`."""
    return pending_runs(grid, committed_runs(grid.sparkSession, path))


def route(df: DataFrame, window: Column, default: int = 252) -> DataFrame:
    """Results of other training windows than the default one get a `route` of their own: the folder they belong to."""
    return df.withColumn("route", F.when(window == default, "default").otherwise(F.concat(F.lit("window_"), window.cast("string"))))


def write_routed(df: DataFrame, path: str, window: Column, default: int = 252, fmt: str = "parquet") -> None:
    """A folder per route, and in it per model, horizon and symbol: a scan of one route reads no other, and a run that is written again takes the place of the first."""
    routed = route(df, window, default).withColumn("model", clean_name(F.col("model")))
    routed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("route", "model", "horizon", "symbol").format(fmt).option("header", True).save(path)


def write_metrics(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)
