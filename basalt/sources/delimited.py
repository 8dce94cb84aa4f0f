"""``|``-separated files with a Parquet copy made on first use."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..catalog import Catalog, Table
from ..types import SqlType

#: A line's last separator may be followed by nothing; this takes that column.
_TRAILER = "__end_of_line"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_delimited(spark: SparkSession, path: str, declared: Mapping[str, str]) -> DataFrame:
    """Rows of a headerless, unquoted file; a value that does not parse fails the read."""
    schema = T.StructType([T.StructField(c, SqlType.parse(t).source, False) for c, t in declared.items()])
    head = spark.read.text(path).limit(1).collect()
    if head and head[0][0].endswith("|"):
        schema = schema.add(_TRAILER, T.StringType(), True)
    return (
        spark.read.schema(schema)
        .csv(path, sep="|", header=False, quote="", escape="", mode="FAILFAST", dateFormat="yyyy-MM-dd")
        .select(*declared)
    )


def _state(spark: SparkSession, path: str) -> str:
    """Size and time of the files at a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return ""
    return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in (fs.globStatus(p) if not fs.getFileStatus(p).isDirectory() else fs.listStatus(p))))


def load_delimited(
    catalog: Catalog, name: str, path: str, declared: Mapping[str, str],
    cache: str | None = None, num_lines: int = -1, rows: int | None = None,
) -> Table:
    """Registers the file as a table.

    ``cache`` is where its Parquet copy lies; it is read instead of the file
    until the file changes (by size or time), or where the file is gone.
    ``num_lines`` stops after that many lines, as its own feature.
    """
    spark = catalog.spark
    if num_lines >= 0:
        return catalog.add(name, read_delimited(spark, path, declared).limit(num_lines), declared, rows)
    if cache is None:
        return catalog.add(name, read_delimited(spark, path, declared), declared, rows)
    now, kept = _state(spark, path), f"{cache}-state"
    same = _exists(spark, f"{cache}/_SUCCESS") and (not now or _exists(spark, f"{kept}/_SUCCESS") and [r[0] for r in spark.read.text(kept).collect()] == [now])
    if not same:
        read_delimited(spark, path, declared).write.mode("overwrite").parquet(cache)
        spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(kept)
    return catalog.add(name, spark.read.parquet(cache), declared, rows)


def write_delimited(df: DataFrame, path: str) -> None:
    """The rows as headerless ``|``-separated files, as :func:`read_delimited` takes them."""
    df.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").csv(path, sep="|", header=False, quote="", escape="", emptyValue="")


def append_rows(table: Table, lines: Iterable[str]) -> Table:
    """Adds ``|``-separated lines to a table, parsed by its declared types; a
    line may end with a separator, and else has as many fields as the table."""
    types = list(table.columns.values())

    def value(t: SqlType, text: str):
        from decimal import Decimal

        return Decimal(text) if t.kind == "decimal" else t.literal(text)

    def row(line: str) -> tuple:
        fields = line.rstrip("\n").split("|")
        if len(fields) == len(types) + 1 and not fields[-1]:
            fields.pop()
        if len(fields) != len(types):
            raise ValueError(f"{table.name}: {len(fields)} fields instead of {len(types)} in {line!r}")
        return tuple(value(t, v) for t, v in zip(types, fields, strict=True))

    return table.append([row(line) for line in lines])
