"""Train and validation sets."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portvigil.functions.times import ntz
from portvigil.spec import TRAIN_DAYS, VALIDATION_DAYS, WINDOW_SIZE


def _midnight(day: date) -> datetime:
    return datetime.combine(day, datetime.min.time())


def within_days(first: date, last: date) -> str:
    """Whole days, both included."""
    start, end = _midnight(first), _midnight(last + timedelta(days=1))
    return f"occur_date >= {ntz(start)} and occur_date < {ntz(end)}"


def split_by_dates(
    df: DataFrame, train_start: date, train_end: date, test_start: date, test_end: date
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by inclusive day ranges, which may overlap."""
    return df.where(within_days(train_start, train_end)), df.where(within_days(test_start, test_end))


def split_days(as_of: datetime) -> tuple[date, date, date, date]:
    """Default ranges for ``split_by_dates``; the day they share is in both sets."""
    today = as_of.date()
    middle = today - timedelta(days=VALIDATION_DAYS)
    return today - timedelta(days=TRAIN_DAYS), middle, middle, today


def cutoff_of(as_of: datetime, days: int = VALIDATION_DAYS) -> datetime:
    return _midnight(as_of.date() - timedelta(days=days))


def split_by_cutoff(df: DataFrame, as_of: datetime, days: int = TRAIN_DAYS) -> DataFrame:
    """Labels the collected range: ``train`` before the cut-off day, ``test`` from it on."""
    collected = df.where(f"occur_date between {ntz(as_of - timedelta(days=days))} and {ntz(as_of)}")
    label = f"if(occur_date < {ntz(cutoff_of(as_of))}, 'train', 'test')"
    return collected.withColumn("split", F.expr(label))


def split_counts(labelled: DataFrame) -> DataFrame:
    """Rows per track and split."""
    return labelled.groupBy("track", "split").agg(F.count("*").alias("rows"))


def min_sample_gate(train: DataFrame, window_size: int = WINDOW_SIZE) -> DataFrame:
    """One row: number of raw training rows, and whether they suffice for a single window."""
    return train.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(window_size).alias("required"), (F.col("rows") >= window_size).alias("enough")
    )
