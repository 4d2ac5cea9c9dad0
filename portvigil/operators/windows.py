"""Scaling and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portvigil.operators.clean import is_complete
from portvigil.operators.frames import over_trailing
from portvigil.operators.quantiles import FEW, exact_quantiles
from portvigil.spec import KEYS, WINDOW_SIZE, TrackSpec

# feature -> (centre, scale)
Scaler = dict[str, tuple[float, float]]

SCALER_SCHEMA = T.StructType(
    [
        T.StructField("track", T.StringType(), False),
        T.StructField("feature", T.StringType(), False),
        T.StructField("center", T.DoubleType(), False),
        T.StructField("scale", T.DoubleType(), False),
    ]
)


def robust_fit(clean: DataFrame, spec: TrackSpec, few: int = FEW) -> Scaler:
    """Median and inter-quartile range of each metric over complete rows; a zero range becomes 1."""
    quartiles = exact_quantiles(clean.where(is_complete(spec)), list(spec.features), [0.25, 0.5, 0.75], few)
    scaler = {}
    for f, (q1, median, q3) in quartiles.items():
        if median is None:
            raise ValueError(f"no complete {spec.name} rows to fit the scaler on")
        scaler[f] = (median, (q3 - q1) or 1.0)
    return scaler


def scaler_frame(spark: SparkSession, spec: TrackSpec, scaler: Scaler) -> DataFrame:
    """The fitted parameters as a table, one row per metric."""
    rows = [(spec.name, f, float(c), float(s)) for f, (c, s) in scaler.items()]
    return spark.createDataFrame(rows, SCALER_SCHEMA)


def load_scaler(params: DataFrame, spec: TrackSpec) -> Scaler:
    """Parameters of one track; the table has one row per metric of a track."""
    rows = params.where(F.col("track") == spec.name).collect()
    return {r.feature: (r.center, r.scale) for r in rows}


def double_literal(x: float) -> str:
    """Double literal with all its digits."""
    return f"double('{x!r}')"


def z(feature: str) -> str:
    return f"z_{feature}"


def robust_apply(clean: DataFrame, spec: TrackSpec, scaler: Scaler) -> DataFrame:
    """Adds the scaled metrics; NULL stays NULL, its windows are dropped."""
    return clean.selectExpr("*", *[f"({f} - {double_literal(scaler[f][0])}) / {double_literal(scaler[f][1])} as {z(f)}" for f in spec.features])


def placeholder_filled(clean: DataFrame, spec: TrackSpec) -> DataFrame:
    """Metrics with the track's placeholder for NULL, and ``any_null`` marking those rows."""
    filled = [f"coalesce({f}, {spec.placeholder}D) as {f}" for f in spec.features]
    return clean.select(*KEYS, "slot_idx", *map(F.expr, filled), (~is_complete(spec)).alias("any_null"))


def complete_windows(
    df: DataFrame, spec: TrackSpec, window_size: int = WINDOW_SIZE, **columns: str
) -> DataFrame:
    """Rows that end a window: all of the trailing slots exist and hold every metric.  ``columns`` over
    the same frame are added in the same pass."""
    complete = " and ".join(f"{f} is not null" for f in spec.features)
    added = [f"{column} as {name}" for name, column in columns.items()]
    filled = f"count_if({complete}) {over_trailing(window_size)} as _filled"
    return df.selectExpr("*", *added, filled).where(f"_filled = {window_size}").drop("_filled")


def sliding_windows(scaled: DataFrame, spec: TrackSpec, window_size: int = WINDOW_SIZE) -> DataFrame:
    """Window-end rows with ``seq``, the scaled metrics of the trailing slots, oldest first."""
    seq = f"collect_list(array({', '.join(map(z, spec.features))})) {over_trailing(window_size)}"
    return complete_windows(scaled, spec, window_size, seq=seq).select(*KEYS, "slot_idx", *spec.features, "seq")
