"""Tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import new_folder, shared_folder

__all__ = ["drop", "durable", "new_folder", "shared_folder", "written"]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written to the shared folder and read back, and where they lie:
    no lineage is left that a lost executor could make it repeat."""
    folder = new_folder(df.sparkSession, "rows")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def durable(df: DataFrame) -> DataFrame:
    return written(df)[0]


def drop(spark: SparkSession, folder: str) -> None:
    """Removes a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
