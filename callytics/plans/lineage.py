"""Cutting lineage with tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import get_ident
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from callytics.session import checkpoint_root

# The open scopes of each thread, the innermost last.
_open_scopes: dict[int, list[list[str]]] = {}


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that `cut` writes inside, once the caller has written what it built on them."""
    scopes = _open_scopes.setdefault(get_ident(), [])
    scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, scopes.pop()):
            path.getFileSystem(conf).delete(path, True)
        if not scopes:
            del _open_scopes[get_ident()]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and read it back.

    For results several plans build on: they are computed once, survive the loss of an
    executor, and give Spark their true size for choosing joins. Inside a `scope` the table is
    removed at its end.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{name}-{uuid4().hex}"
    if scopes := _open_scopes.get(get_ident()):
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
