"""What the operators share: reading the tables, stored intermediate results, batch sizes."""

from __future__ import annotations

import gc
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from callytics.session import checkpoint_root

#: Rows of one Arrow batch; texts differ a lot in length, so batches are kept short.
BATCH_ROWS = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh name in the folder that all executors share."""
    return f"{checkpoint_root(spark)}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the memory of Python workers by short Arrow batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_memory: dict[str, object] = {}


def worker_memory(name: str, make: Callable[[], object]) -> object:
    """What a Python worker remembers between tasks, made once. It keeps one such memory: a worker that serves another
    operator gives up the earlier one, so memories of several operators never add up."""
    if name not in _memory:
        _memory.clear()
        gc.collect()
        _memory[name] = make()
    return _memory[name]


def partitions_of(spark: SparkSession) -> int:
    """The session's shuffle width; it is set by the amount of data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
