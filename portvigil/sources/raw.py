"""Readers for the raw metric tracks.

Raw data is one dataset per track, partitioned by ``pm_hour`` (``yyyy-MM-dd-HH``).  A time range turns
into a partition filter plus a pushed-down row filter; hours without data need no check.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portvigil.functions.times import hour_key, ntz
from portvigil.spec import OPTICAL_SCHEMA, SIGNAL_ETH, TRAFFIC_RAW_SCHEMA
from portvigil.storage import partition_values

HOUR_COL = "pm_hour"
#: Folder of the rows without an hour.
NO_HOUR = "__HIVE_DEFAULT_PARTITION__"
# Times in files keep their microseconds.
CSV_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
# Physical metric name -> name used everywhere else.
TRAFFIC_RENAMES = {"bbe_in_error": "error_packet", "es": "tx_packet", "ses": "rx_packet"}


def filter_time_range(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Rows with ``start <= occur_date <= end``; without a range, all rows."""
    if start is None or end is None:
        return df
    return df.where(f"occur_date between {ntz(start)} and {ntz(end)}")


def filter_signal_type(df: DataFrame, signal_type: int = SIGNAL_ETH) -> DataFrame:
    return df.where(F.col("signal_type") == signal_type)


def scan_traffic(raw: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Ethernet readings of the range under their track names."""
    rows = filter_signal_type(prune_hours(filter_time_range(raw, start, end), start, end))
    renamed = [F.col(old).alias(new) for old, new in TRAFFIC_RENAMES.items()]
    return rows.select("occur_date", "ip_addr", "cid", "lid", *renamed)


def scan_optical(raw: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    rows = prune_hours(filter_time_range(raw, start, end), start, end)
    return rows.select("occur_date", "ip_addr", "cid", "lid", "tx_avg_power", "rx_avg_power")


def in_hours(hour: Column, start: datetime, end: datetime) -> Column:
    """Shards touched by the range; both ends are cut to the hour, so the last one is never missed."""
    return hour.between(start.strftime("%Y-%m-%d-%H"), end.strftime("%Y-%m-%d-%H"))


def prune_hours(df: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Partition filter on the shard column, for datasets that have one."""
    if HOUR_COL not in df.columns or start is None or end is None:
        return df
    return df.where(in_hours(F.col(HOUR_COL), start, end))


def with_hour(df: DataFrame) -> DataFrame:
    return df.withColumn(HOUR_COL, F.expr(hour_key("occur_date")))


def shard_union(shards: Iterable[DataFrame]) -> DataFrame | None:
    """One frame out of separately read shards; columns a shard lacks are NULL; no shard gives None."""
    shards = list(shards)
    if not shards:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def write_hourly(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write readings as an hour-partitioned dataset.  Rebalancing gathers an hour in few files and splits
    an hour that is too large for one task."""
    with_hour(df).hint("rebalance", HOUR_COL).write.partitionBy(HOUR_COL).mode(mode).parquet(path)


def _hourly_schema(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(HOUR_COL, T.StringType())])


def read_hourly(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(_hourly_schema(schema)).parquet(path)


def hours_of(spark: SparkSession, path: str, schema: T.StructType, hours: list[str]) -> DataFrame:
    """Rows of some hours of the dataset, by their folders."""
    reader = spark.read.schema(_hourly_schema(schema)).option("basePath", path)
    return reader.parquet(*(f"{path}/{HOUR_COL}={h}" for h in hours))


def read_hours(spark: SparkSession, path: str, schema: T.StructType, start: datetime, end: datetime | None = None) -> DataFrame:
    """Rows of the hours from ``start`` on, up to ``end`` if given, and rows without an hour, by the folders' paths.

    Only the names in the dataset's folder are listed, not the files of all its hours.
    """
    first, last = (t and t.strftime("%Y-%m-%d-%H") for t in (start, end))
    hours = partition_values(spark, path, HOUR_COL)
    touched = [h for h in hours if h == NO_HOUR or (h >= first and (last is None or h <= last))]
    if not touched:
        return spark.createDataFrame([], _hourly_schema(schema))
    return hours_of(spark, path, schema, touched)


def read_traffic(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    return scan_traffic(read_hours(spark, path, TRAFFIC_RAW_SCHEMA, start, end), start, end)


def read_optical(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    return scan_optical(read_hours(spark, path, OPTICAL_SCHEMA, start, end), start, end)


def stream_hourly(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """The same dataset as a stream of newly arrived files."""
    reader = spark.readStream.schema(_hourly_schema(schema))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Train or test rows written as CSV with a header."""
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def hour_tables(prefix: str, start: datetime, end: datetime) -> list[str]:
    """Names of the hourly tables ``<prefix>YYYY_MM_DD_HH`` a range touches, first to last."""
    first = start.replace(minute=0, second=0, microsecond=0)
    hours = int((end - first).total_seconds() // 3600) + 1
    return [f"{prefix}{(first + timedelta(hours=i)).strftime('%Y_%m_%d_%H')}" for i in range(hours)]


def range_query(table: str, columns: str, start: datetime, end: datetime, condition: str = "") -> str:
    """SELECT of one hourly table, so that projection and filters run inside the database."""
    extra = f"{condition} AND " if condition else ""
    return f"SELECT {columns} FROM {table} WHERE {extra}occur_date BETWEEN '{start}' AND '{end}'"


def _read_jdbc(
    spark: SparkSession, options: dict[str, str], queries: list[str]
) -> DataFrame | None:
    reads = (spark.read.format("jdbc").options(**options).option("query", q).load() for q in queries)
    return shard_union(reads)


def _present(tables: list[str], existing: Iterable[str] | None) -> list[str]:
    return tables if existing is None else [t for t in tables if t in set(existing)]


def traffic_queries(
    prefix: str, start: datetime, end: datetime, existing: Iterable[str] | None = None
) -> list[str]:
    columns = ", ".join(["occur_date, ip_addr, cid, lid", *(f"{o} AS {n}" for o, n in TRAFFIC_RENAMES.items())])
    tables = _present(hour_tables(prefix, start, end), existing)
    return [range_query(t, columns, start, end, f"signal_type = {SIGNAL_ETH}") for t in tables]


def optical_queries(
    prefix: str, start: datetime, end: datetime, existing: Iterable[str] | None = None
) -> list[str]:
    columns = "occur_date, ip_addr, cid, lid, tx_avg_power, rx_avg_power"
    return [range_query(t, columns, start, end) for t in _present(hour_tables(prefix, start, end), existing)]


def read_traffic_jdbc(spark, options, prefix, start, end, existing=None) -> DataFrame | None:
    """Traffic out of hour-sharded database tables; ``existing`` lists the tables that are there."""
    return _read_jdbc(spark, options, traffic_queries(prefix, start, end, existing))


def read_optical_jdbc(spark, options, prefix, start, end, existing=None) -> DataFrame | None:
    return _read_jdbc(spark, options, optical_queries(prefix, start, end, existing))


def shard_counts(hourly: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Hour shards that the range touches and that hold rows; the filter is on the partition column."""
    return prune_hours(hourly, start, end).groupBy(HOUR_COL).agg(F.count("*").alias("rows"))
