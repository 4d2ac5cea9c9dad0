"""Per-track settings: a table of trained versions laid over the defaults."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portvigil.spec import CONFIG_DEFAULTS, TRACK_CONFIG_SCHEMA, TRACKS

MODEL_TYPE = "linear-autoencoder"
OVERRIDABLE = ("threshold", "slope_threshold", "rul_target")


@dataclass(frozen=True)
class TrackSettings:
    """What scoring and fusion need to know about a track."""

    threshold: float
    slope_threshold: float = CONFIG_DEFAULTS["slope_threshold"]
    rul_target: float = CONFIG_DEFAULTS["rul_target"]
    window_size: int = CONFIG_DEFAULTS["window_size"]


def config_row(spark: SparkSession, track: str, version: int = 1, **values) -> DataFrame:
    """A one-row ``track_config`` frame; what is not given is NULL and falls back to the defaults."""
    row = {"track": track, "version": version, "model_type": MODEL_TYPE, **values}
    return spark.createDataFrame([tuple(row.get(c) for c in TRACK_CONFIG_SCHEMA.names)], TRACK_CONFIG_SCHEMA)


def newest_config(versions: DataFrame) -> DataFrame:
    """The highest version of each track."""
    rest = [c for c in TRACK_CONFIG_SCHEMA.names if c != "track"]
    newest = versions.groupBy("track").agg(F.max_by(F.struct(*rest), "version").alias("c"))
    return newest.select("track", *[F.col(f"c.{c}").alias(c) for c in rest])


def resolve_config(versions: DataFrame) -> DataFrame:
    """Newest version of each track over the defaults; a track without a threshold is skipped."""
    newest = newest_config(versions).where(F.col("threshold").isNotNull())
    return newest.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in CONFIG_DEFAULTS.items()})


def override_config(versions: DataFrame, track: str, **settings) -> DataFrame:
    """The version that replaces the newest one of ``track`` with some settings changed."""
    unknown = set(settings) - set(OVERRIDABLE)
    if unknown:
        raise ValueError(f"not a setting: {sorted(unknown)}")
    kinds = {f.name: f.dataType for f in TRACK_CONFIG_SCHEMA.fields}
    changes = {name: F.lit(value).cast(kinds[name]) for name, value in settings.items()}
    current = newest_config(versions).where(F.col("track") == track)
    return current.withColumns({"version": F.col("version") + 1, **changes}).select(*TRACK_CONFIG_SCHEMA.names)


def track_settings(versions: DataFrame) -> dict[str, TrackSettings]:
    """Resolved settings on the driver; the table resolves to one row per track."""
    fields = ("threshold", "slope_threshold", "rul_target", "window_size")
    return {r.track: TrackSettings(*[r[f] for f in fields]) for r in resolve_config(versions).collect()}


def lookup_config(rows: DataFrame, resolved: DataFrame, *fields: str) -> DataFrame:
    """Settings of each row's ``track``.  The build side has one row per track, whatever the data."""
    return rows.join(F.broadcast(resolved.select("track", *fields)), "track")


def model_status(spark: SparkSession, versions: DataFrame) -> DataFrame:
    """Every known track with its training record and settings, defaults where it has no model."""
    names = spark.createDataFrame([(t,) for t in TRACKS], "track string")
    joined = names.join(newest_config(versions), "track", "left")
    shown = ("threshold", "slope_threshold", "threshold_percentile", "patience", "latent_dim", "samples_used")
    values = [F.coalesce(F.col(c), F.lit(CONFIG_DEFAULTS[c])).alias(c) for c in shown]
    return joined.select(
        "track",
        F.col("version").isNotNull().alias("exists"),
        F.col("trained_at").alias("last_trained"),
        *values,
        "final_val_loss",
    )


def write_config(version: DataFrame, path: str) -> None:
    """Append a version to the stored table."""
    version.coalesce(1).write.mode("append").parquet(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACK_CONFIG_SCHEMA).parquet(path)
