"""Result table and file sinks.

Results live in a Parquet dataset partitioned by ``occur_hour``.  A cycle touches one hour, so an upsert
rewrites at most the four slots of that hour.  Files of an hour are sorted by port and carry Bloom filters of the
address, so the history of one port reads the pages of that port only.  Every rewrite is staged first, each row written once; then
the hours' folders are exchanged by renaming.  A folder that is exchanged is kept aside until its successor is
in place, and an exchange that was broken off is undone by the next upsert.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portvigil.functions.scores import finite_or_null
from portvigil.functions.times import hour_key, ntz
from portvigil.operators.reports import RESULT_HOUR
from portvigil.sources.raw import CSV_OPTIONS
from portvigil.spec import KEYS, NULLABLE_RESULT_COLS, RESULT_COLS, RESULT_SCHEMA, RETENTION_DAYS
from portvigil.storage import drop_path, partition_values, replace_folder, restore_folder, work_path

UPSERT_KEYS = ("occur_date", *KEYS)
STORED_SCHEMA = T.StructType(RESULT_SCHEMA.fields + [T.StructField(RESULT_HOUR, T.StringType())])
# Column defaults of the result table that are not 0, false or empty.
TEXT_DEFAULTS = {"slope_label": "STABLE", "alarm_label": "NORMAL"}

#: Bloom filters let a scan for one address skip row groups that merely have it in their range of values.
SKIP_OPTIONS = {"parquet.bloom.filter.enabled#ip_addr": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def ensure_schema(df: DataFrame, detect_time: datetime | None = None) -> DataFrame:
    """All result columns in order and type; absent ones get the default of the table."""
    columns = []
    for field in RESULT_SCHEMA.fields:
        if field.name in df.columns:
            column = F.col(field.name)
        elif field.name == "detect_time":
            column = F.expr(ntz(detect_time)) if detect_time else F.lit(None)
        elif field.name in NULLABLE_RESULT_COLS:
            column = F.lit(None)
        else:
            column = _default(field)
        columns.append(column.try_cast(field.dataType).alias(field.name))
    return df.select(*columns)


def _default(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.lit(TEXT_DEFAULTS.get(field.name, ""))
    return F.lit(0).cast(field.dataType)


def sanitize(df: DataFrame) -> DataFrame:
    """Numbers that cannot be stored become 0, missing text empty; ttf and times keep NULL."""
    columns = []
    for field in RESULT_SCHEMA.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = F.expr(finite_or_null(field.name))
        if field.name not in NULLABLE_RESULT_COLS:
            empty = F.lit("") if isinstance(field.dataType, T.StringType) else F.lit(0).cast(field.dataType)
            column = F.coalesce(column, empty)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def merge_upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows, one per port and slot, replace existing rows of the same port and slot."""
    kept = existing.join(new.select(*UPSERT_KEYS), list(UPSERT_KEYS), "left_anti")
    return kept.select(*RESULT_COLS).unionByName(new.select(*RESULT_COLS))


def retained(results: DataFrame, as_of: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than the retention period."""
    return results.where(f"occur_date >= {ntz(as_of - timedelta(days=days))}")


# --- stored table ----------------------------------------------------------------------------------


def stored_hours(spark: SparkSession, path: str) -> list[str]:
    return partition_values(spark, path, RESULT_HOUR)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_SCHEMA).parquet(path)


def results_sql(spark: SparkSession, path: str, sql: str, **args) -> DataFrame:
    """SQL over the stored results, known as ``{results}`` in the text; ``args`` fill ``:name`` markers."""
    return spark.sql(sql, args=args, results=read_results(spark, path))


def _staged(rows: DataFrame, path: str | None = None) -> str:
    """``rows`` in the layout of the result table, in a folder of their own or added to ``path``."""
    path = path or work_path(rows.sparkSession, "results")
    by_hour = rows.withColumn(RESULT_HOUR, F.expr(hour_key("occur_date"))).hint("rebalance", RESULT_HOUR)
    ordered = by_hour.sortWithinPartitions(RESULT_HOUR, *KEYS, "occur_date")
    ordered.write.mode("append").options(**SKIP_OPTIONS).partitionBy(RESULT_HOUR).parquet(path)
    return path


#: Holds the hours that are being exchanged; readers skip folders of such names.
_ASIDE = "_replaced"


def _replace_hours(spark: SparkSession, staged: str, path: str) -> None:
    """Exchange the hours of the staged table for those of the result table."""
    for hour in stored_hours(spark, staged):
        name = f"{RESULT_HOUR}={hour}"
        replace_folder(spark, f"{staged}/{name}", f"{path}/{name}", f"{path}/{_ASIDE}/{name}")
    drop_path(spark, staged)


def recover_results(spark: SparkSession, path: str) -> None:
    """Undo exchanges of hours that were broken off."""
    for hour in partition_values(spark, f"{path}/{_ASIDE}", RESULT_HOUR):
        name = f"{RESULT_HOUR}={hour}"
        restore_folder(spark, f"{path}/{name}", f"{path}/{_ASIDE}/{name}")


def _hours_of(spark: SparkSession, path: str, hours: list[str]) -> DataFrame:
    """Rows of some hours of the table, by their folders."""
    reader = spark.read.schema(STORED_SCHEMA).option("basePath", path)
    return reader.parquet(*(f"{path}/{RESULT_HOUR}={hour}" for hour in hours))


def upsert_results(new: DataFrame, path: str, detect_time: datetime, replaced: DataFrame | None = None) -> None:
    """Store detection rows; running the same cycle twice leaves one copy.

    ``new`` is evaluated once, by staging it.  The hours it touches are then known from the staged
    folders; what the table holds in these beside the new rows is added to them, and the folders are exchanged.
    ``replaced`` (time and port) names stored rows that go even where no new row takes their place.
    """
    spark = new.sparkSession
    recover_results(spark, path)
    staged = _staged(sanitize(ensure_schema(new, detect_time)))
    arrived_hours, table_hours = set(stored_hours(spark, staged)), set(stored_hours(spark, path))
    gone_hours: set[str] = set()
    if replaced is not None:
        gone_hours = {r[0] for r in replaced.select(F.expr(hour_key("occur_date"))).distinct().collect()} & table_hours
    hours = sorted(arrived_hours & table_hours | gone_hours)
    if hours:
        merged = sorted(arrived_hours & set(hours))
        leaving = [_hours_of(spark, staged, merged).select(*UPSERT_KEYS)] if merged else []
        leaving += [replaced.select(*UPSERT_KEYS)] if replaced is not None else []
        kept = _hours_of(spark, path, hours)
        for keys in leaving:
            kept = kept.join(keys, list(UPSERT_KEYS), "left_anti")
        _staged(kept.select(*RESULT_COLS), staged)
        for hour in gone_hours - set(stored_hours(spark, staged)):
            drop_path(spark, f"{path}/{RESULT_HOUR}={hour}")  # nothing of it is left
    _replace_hours(spark, staged, path)


def expire_results(spark: SparkSession, path: str, as_of: datetime, days: int = RETENTION_DAYS) -> None:
    """Drop whole expired hours; rewrite the hour the limit falls in."""
    limit = as_of - timedelta(days=days)
    edge = limit.strftime("%Y-%m-%d-%H")
    hours = stored_hours(spark, path)
    for hour in (h for h in hours if h < edge):
        drop_path(spark, f"{path}/{RESULT_HOUR}={hour}")
    if edge in hours:
        staged = _staged(retained(_hours_of(spark, path, [edge]), as_of, days).select(*RESULT_COLS))
        if stored_hours(spark, staged):
            _replace_hours(spark, staged, path)
        else:
            drop_path(spark, f"{path}/{RESULT_HOUR}={edge}")
            drop_path(spark, staged)


# --- files -----------------------------------------------------------------------------------------


def append_history(results: DataFrame, path: str, as_of: datetime, cycle: str) -> None:
    """Full results of one cycle in the log of its day; repeating the cycle replaces its own files."""
    target = f"{path}/run_date={as_of:%Y%m%d}/cycle={cycle}"
    results.write.mode("overwrite").options(**CSV_OPTIONS).csv(target)


def write_report(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_split(df: DataFrame, path: str) -> None:
    """One split of one track as CSV.  Range partitioning sorts it as a whole by port and time and
    divides a large port over several files."""
    ordered = df.repartitionByRange(*KEYS, "occur_date").sortWithinPartitions(*KEYS, "occur_date")
    ordered.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
