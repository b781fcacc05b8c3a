"""Long panels of realized measures: scans, checks and preprocessing.

A panel has one row per symbol and date: `rv` (realized variance), `bv` (bipower
variation), `good` and `bad` (semivariances), `rq` (quarticity). It stays long; wide
tables are made only for export.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspan.functions.numeric import clip_low, non_null

#: Names in the files and ours.
MEASURES = {"rv5": "rv", "bv5": "bv", "rsp5": "good", "rsn5": "bad", "rq5": "rq"}
RAW_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in MEASURES])


def scan_panel(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, fmt: str = "csv") -> DataFrame:
    """Read a long panel with a fixed schema; only the seven columns are read, and the filter goes to the scan.

    CSV columns are matched by name through the header, so files may hold more columns.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
        raw = raw.select(F.to_date(F.substring("date", 1, 10)).alias("date"), "symbol", *[F.expr(f"try_cast({c} AS double)").alias(c) for c in MEASURES])
    else:
        raw = spark.read.format(fmt).load(path).select([F.col(f.name).cast(f.dataType) for f in RAW_SCHEMA])
    return filter_symbols(raw, symbols)


def scan_panel_checked(spark: SparkSession, path: str, symbols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """`scan_panel` of CSV files without silent nulls: the rows that can be read, and the rejects.

    A reject has `file`, `record` and `reasons`: columns whose value is not of their type, `symbol` or `date` if empty, and `columns` for a line of
    too few or too many values. An empty measure is a null, no reject.
    """
    header = spark.read.option("header", True).csv(path).schema
    schema = T.StructType([*[T.StructField(f.name, T.StringType()) for f in header], T.StructField("bad line", T.StringType())])
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad line").option("columnPruning", False).schema(schema).csv(path)
    typed = {"date": F.to_date(F.try_to_timestamp(F.substring("date", 1, 10), F.lit("yyyy-MM-dd")))} | {c: F.expr(f"try_cast({c} AS double)") for c in MEASURES}
    wrong = [F.when(F.col("`bad line`").isNotNull(), "columns"), F.when(F.col("symbol").isNull(), "symbol"), F.when(typed["date"].isNull(), "date")]
    wrong += [F.when(F.col(c).isNotNull() & typed[c].isNull(), c) for c in MEASURES]
    reasons = F.filter(F.array(*wrong), lambda x: x.isNotNull())
    line = F.concat_ws(",", *[F.coalesce(F.col(f.name), F.lit("")) for f in header])
    seen = raw.select("*", F.col("_metadata.file_path").alias("file of row"), reasons.alias("reasons of row"))
    good = seen.where(F.size("reasons of row") == 0).select(typed["date"].alias("date"), "symbol", *[typed[c].alias(c) for c in MEASURES])
    rejects = seen.where(F.size("reasons of row") > 0).select(F.col("file of row").alias("file"), F.coalesce("bad line", line).alias("record"), F.col("reasons of row").alias("reasons"))
    return filter_symbols(good, symbols), rejects


def rejects_by_file(rejects: DataFrame) -> DataFrame:
    """Rejected lines of each file, by reason; a line counts once for every reason."""
    return rejects.select("file", F.explode("reasons").alias("reason")).groupBy("file", "reason").agg(F.count("*").alias("rejects"))


def scan_by_class(spark: SparkSession, paths: dict[str, str], dataset: str = "stocks", symbols: Sequence[str] | None = None, fmt: str = "csv") -> DataFrame:
    """Panel of one asset class from a file per class; unknown names mean the first class."""
    name = dataset if dataset in paths else next(iter(paths))
    return project_measures(scan_panel(spark, paths[name], symbols, fmt)).withColumn("asset_class", F.lit(name))


def union_classes(panels: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in panels.items():
        df = df.withColumn("asset_class", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def project_measures(raw: DataFrame) -> DataFrame:
    """Our names for the measures; NaN becomes null."""
    return raw.select("date", "symbol", *[non_null(F.col(a)).alias(b) for a, b in MEASURES.items()])


def filter_symbols(df: DataFrame, symbols: Sequence[str] | None) -> DataFrame:
    return df if symbols is None else df.where(F.col("symbol").isin(*symbols))


def symbols_or_all(df: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Rows of the requested symbols that exist; all rows if none of them exists."""
    any_there = df.where(F.col("symbol").isin(*symbols)).select(F.lit(True).alias("wanted")).limit(1)
    flagged = df.crossJoin(F.broadcast(any_there.agg(F.count("*").alias("found"))))  # one row
    return flagged.where((F.col("found") == 0) | F.col("symbol").isin(*symbols)).drop("found")


def panel_duplicates(df: DataFrame) -> DataFrame:
    return df.groupBy("date", "symbol").agg(F.count("*").alias("n")).where("n > 1")


def panel_pivot(df: DataFrame, measure: str = "rv", symbols: Sequence[str] | None = None) -> DataFrame:
    """Dates x symbols, for export. Listing the symbols saves the pass that finds them."""
    return df.groupBy("date").pivot("symbol", list(symbols) if symbols else None).agg(F.first(measure)).orderBy("date")


def winsorize(df: DataFrame, share: float = 0.995) -> DataFrame:
    """Clip `rv` above its quantile per symbol (linear interpolation)."""
    top = df.groupBy("symbol").agg(F.percentile("rv", F.lit(share)).alias("top"))
    return df.join(top, "symbol").withColumn("rv", F.when(F.col("rv") > F.col("top"), F.col("top")).otherwise(F.col("rv"))).drop("top")


def preprocess(df: DataFrame, symbols: Sequence[str] | None = None, winsor: bool = False, winsor_share: float = 0.995) -> DataFrame:
    """Add `log_rv` and `jump`; optionally winsorize first."""
    out = symbols_or_all(df, symbols) if symbols else df
    out = winsorize(out, winsor_share) if winsor else out
    return with_jump(with_log(out))


def with_log(df: DataFrame) -> DataFrame:
    """Natural log; null for values that are not positive."""
    return df.withColumn("log_rv", F.when(F.col("rv") > 0, F.ln("rv")))


def with_jump(df: DataFrame) -> DataFrame:
    """max(rv - bv, 0), null where either is."""
    return df.withColumn("jump", clip_low(F.col("rv") - F.col("bv"), 0.0))


def observed(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all of the columns are present: windows count available days."""
    for c in columns:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(c))
    return df
