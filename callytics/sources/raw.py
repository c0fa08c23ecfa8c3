"""The given Parquet tables, with declared schemas so that opening one starts no job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Schemas of the given tables. Zone-free times are read as UTC instants, without
# a cast, so that filters on them reach the scan.
RAW_TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp"
    ),
    "events": (
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load_raw(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A given table."""
    return spark.read.schema(RAW_TABLES[table]).parquet(f"{folder.rstrip('/')}/{table}.parquet")


def stream_raw(
    spark: SparkSession, folder: str, table: str, max_bytes: int = 1 << 30, max_files: int | None = None
) -> DataFrame:
    """The same as a stream: of the table's file, or of the files in its folder, oldest first.

    `max_bytes` and `max_files` bound what a micro-batch takes in, and with it the rows of a key.
    """
    path = f"{folder.rstrip('/')}/{table}.parque[t]"  # a pattern: only by one may a stream read a single file
    reader = spark.readStream.schema(RAW_TABLES[table])
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)
