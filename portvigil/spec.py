"""Constants, track descriptions and schemas shared by every module."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KEYS = ("ip_addr", "cid", "lid")

# Fixed values of the data model.
INTERVAL_MINUTES = 15
WINDOW_SIZE = 12
TREND_SLOTS = 4
LATENT_DIM = 16
THRESHOLD_PERCENTILE = 99.9
PATIENCE = 10
# Relative gain in held-out loss that a larger model must bring; nested components always gain a little.
MIN_GAIN = 0.02
DEFAULT_THRESHOLD = 0.1
SLOPE_THRESHOLD = 1.0
RUL_TARGET = 90.0
RETENTION_DAYS = 30
SIGNAL_ETH = 6
SIGNAL_OPTIC = 44
DEAD_POWER = -39.9
MAX_ERROR_PACKETS = 1000
MAX_PACKETS = 1e9
WEAK_POWER = -20
HIGH_ERROR_PACKETS = 100
TRAIN_DAYS = 37
VALIDATION_DAYS = 7
PAGE_SIZE = 10
ALARM_LIST_SIZE = 30

# Alarm tiers, highest first: (severity from, level, label).
ALARM_TIERS = ((90.0, 3, "CRITICAL"), (70.0, 2, "MAJOR"), (50.0, 1, "MINOR"))
NORMAL_TIER = (0, "NORMAL")


@dataclass(frozen=True)
class TrackSpec:
    """One group of metrics that is cleaned, scored and flagged on its own."""

    name: str
    features: tuple[str, ...]
    log_scaled: bool
    placeholder: float

    @property
    def score(self) -> str:
        return f"{self.name}_score"

    @property
    def severity(self) -> str:
        return f"{self.name}_severity"

    @property
    def slope(self) -> str:
        return f"{self.name}_slope"

    @property
    def threshold(self) -> str:
        return f"{self.name}_threshold"

    @property
    def reason(self) -> str:
        return f"{self.name}_reason"

    @property
    def flag(self) -> str:
        return f"is_{self.name}_anomaly"


TRAFFIC = TrackSpec("traffic", ("tx_packet", "rx_packet", "error_packet"), True, 0.0)
OPTICAL = TrackSpec("optical", ("tx_avg_power", "rx_avg_power"), False, -40.0)
TRACKS = {t.name: t for t in (TRAFFIC, OPTICAL)}

_key_fields = [
    T.StructField("occur_date", T.TimestampNTZType(), False),
    T.StructField("ip_addr", T.StringType(), False),
    T.StructField("cid", T.IntegerType(), False),
    T.StructField("lid", T.IntegerType(), False),
]

TRAFFIC_RAW_SCHEMA = T.StructType(
    _key_fields
    + [
        T.StructField("signal_type", T.IntegerType()),
        T.StructField("bbe_in_error", T.LongType()),
        T.StructField("es", T.LongType()),
        T.StructField("ses", T.LongType()),
    ]
)
TRAFFIC_SCHEMA = T.StructType(
    _key_fields + [T.StructField(f, T.LongType()) for f in ("error_packet", "tx_packet", "rx_packet")]
)
OPTICAL_SCHEMA = T.StructType(
    _key_fields + [T.StructField(f, T.DoubleType()) for f in ("tx_avg_power", "rx_avg_power")]
)


def _track_fields(spec: TrackSpec) -> list[T.StructField]:
    return [
        T.StructField(spec.score, T.DoubleType()),
        T.StructField(spec.severity, T.DoubleType()),
        T.StructField(spec.slope, T.DoubleType()),
        T.StructField(spec.threshold, T.DoubleType()),
        T.StructField(spec.flag, T.BooleanType()),
    ]


# What detection returns, in its canonical column order.
DETECTION_SCHEMA = T.StructType(
    _key_fields
    + [T.StructField(f, T.LongType()) for f in TRAFFIC.features]
    + [T.StructField(f, T.DoubleType()) for f in OPTICAL.features]
    + _track_fields(TRAFFIC)
    + _track_fields(OPTICAL)
    + [
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("severity", T.DoubleType()),
        T.StructField("slope", T.DoubleType()),
        T.StructField("slope_label", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("alarm_level", T.IntegerType()),
        T.StructField("alarm_label", T.StringType()),
        T.StructField("ttf_minutes", T.DoubleType()),
        T.StructField("expected_fatal_time", T.TimestampNTZType()),
        T.StructField("anomaly_reason", T.StringType()),
    ]
)

# What is stored: the detection row plus the time it was written.
RESULT_SCHEMA = T.StructType(
    DETECTION_SCHEMA.fields + [T.StructField("detect_time", T.TimestampNTZType())]
)
STANDARD_COLS = tuple(DETECTION_SCHEMA.fieldNames())
RESULT_COLS = tuple(RESULT_SCHEMA.fieldNames())

# Stored columns that keep NULL instead of a default.
NULLABLE_RESULT_COLS = ("ttf_minutes", "expected_fatal_time", "occur_date", "detect_time")

TRACK_CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("track", T.StringType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("model_type", T.StringType()),
        T.StructField("trained_at", T.TimestampNTZType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("slope_threshold", T.DoubleType()),
        T.StructField("rul_target", T.DoubleType()),
        T.StructField("threshold_percentile", T.DoubleType()),
        T.StructField("window_size", T.IntegerType()),
        T.StructField("latent_dim", T.IntegerType()),
        T.StructField("patience", T.IntegerType()),
        T.StructField("samples_used", T.LongType()),
        T.StructField("final_val_loss", T.DoubleType()),
    ]
)

# Defaults laid under the trained metadata of a track.
CONFIG_DEFAULTS = {
    "threshold": DEFAULT_THRESHOLD,
    "slope_threshold": SLOPE_THRESHOLD,
    "rul_target": RUL_TARGET,
    "threshold_percentile": THRESHOLD_PERCENTILE,
    "window_size": WINDOW_SIZE,
    "latent_dim": LATENT_DIM,
    "patience": PATIENCE,
    "samples_used": 0,
}
