"""Work tables in the folder that the driver and all executors share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from volspan.session import new_path


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor
    costs nothing that is already written."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WorkTables:
    """The inner tables of one call, deleted when its `with` block ends.

    What the call returns must not read them: it is `stored` on its own first.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return stored(df, name, self.paths[-1])

    def drop(self, paths: Sequence[str]) -> None:
        """Delete tables that nothing reads any more, through Spark's own file systems."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        self.paths = [p for p in self.paths if p not in paths]

    def __enter__(self) -> WorkTables:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop(list(self.paths))
