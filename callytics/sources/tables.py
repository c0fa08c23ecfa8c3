"""Typed reads of stored tables and versioned / partitioned writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from callytics.sources.schemas import schema


# Fixed value: the file that Spark writes when all files of a folder are in place.
DONE = "_SUCCESS"


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A model table from Parquet, with its declared schema (no inference); `load_current` reads versioned ones."""
    return spark.read.schema(schema(table)).parquet(f"{folder.rstrip('/')}/{table}")


def current_version(spark: SparkSession, folder: str, table: str) -> int | None:
    """The greatest number of a version of a table that is written to its end, None without one."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{table}/version=*/{DONE}")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return max((int(f.getPath().getParent().getName().partition("=")[2]) for f in found or []), default=None)


def load_current(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The newest version of a table written by `write_version` with rising numbers; one still being written doesn't count."""
    version = current_version(spark, folder, table)
    if version is None:
        raise FileNotFoundError(f"{folder}/{table}: no version")
    return spark.read.schema(schema(table)).parquet(f"{folder.rstrip('/')}/{table}/version={version}")


def load_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    **options: str,
) -> DataFrame:
    """A live relational table. With `key` and `bounds` the read is split in ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.options(
            partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
        )
    return reader.options(**options).load()


def with_defaults(df: DataFrame, defaults: Mapping[str, Any | Column]) -> DataFrame:
    """Fill absent or null columns, as column defaults of a stored table would."""
    filled = {}
    for name, value in defaults.items():
        value = value if isinstance(value, Column) else F.lit(value)
        filled[name] = F.coalesce(F.col(name), value) if name in df.columns else value
    return df.withColumns(filled)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Order, cast and complete the columns to the table's schema."""
    out = []
    for field in schema(table).fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def append(
    df: DataFrame,
    folder: str,
    table: str,
    defaults: Mapping[str, Any | Column] | None = None,
    partition_by: tuple[str, ...] = (),
) -> None:
    """Append rows with defaults to a Parquet table."""
    writer = conform(with_defaults(df, defaults or {}), table).write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{folder.rstrip('/')}/{table}")


def write_version(df: DataFrame, folder: str, table: str, version: int | str) -> str:
    """Write a changed table beside the old one; readers move over when it is whole."""
    path = f"{folder.rstrip('/')}/{table}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def append_new(df: DataFrame, path: str, keys: Sequence[str], ts: Column) -> None:
    """Append the rows whose key is not stored yet, by day, each key once: of rows with one key the least row.

    Running it again adds nothing.
    """
    dated = df.withColumn("day", F.to_date(ts))
    row = F.struct(*[F.col(c) for c in dated.columns if c not in keys and c != "day"])
    dated = dated.groupBy("day", *keys).agg(F.min(row).alias("_row")).select("day", *keys, "_row.*").select(*dated.columns)
    try:
        stored = df.sparkSession.read.schema(dated.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        new = dated  # nothing is stored yet
    else:
        new = dated.join(stored.select("day", *keys), ["day", *keys], "left_anti")
    # Even out the files of a day; a large day is split over several tasks.
    new.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def with_period(df: DataFrame, ts: Column, every: str) -> DataFrame:
    return df.withColumn("period", F.trunc(ts.cast("date"), every) if every != "day" else ts.cast("date"))


def write_periods(df: DataFrame, path: str, ts: Column, every: str = "day") -> None:
    """Write a table in folders by period: day, week, month, quarter or year."""
    with_period(df, ts, every).hint("rebalance", "period").write.partitionBy("period").parquet(path)


def load_periods(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table written by `write_periods`, with its period."""
    declared = schema(table)
    return spark.read.schema(f"{declared.simpleString()[7:-1].replace(':', ' ')}, period date").parquet(path)


def replace_periods(rows: DataFrame, path: str, gone: DataFrame) -> None:
    """Put `rows` in place of all rows of their periods; periods of `gone` that get no row are removed.

    Files of other periods stay as they are. `rows` may be made from the table itself: its new files are moved into place
    when all are written. Done again after a failure it gives the same table.
    """
    spark = rows.sparkSession
    # One row per touched period, whatever the number of rows.
    empty = gone.select("period").distinct().join(rows.select("period").distinct(), "period", "left_anti").collect()
    overwrite = rows.hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    overwrite.partitionBy("period").parquet(path)
    for row in empty:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/period={row['period']}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
