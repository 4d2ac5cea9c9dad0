"""Anomaly detection and predictive maintenance for device-port telemetry, on PySpark."""

from portvigil.spec import KEYS, OPTICAL, TRACKS, TRAFFIC, TrackSpec

__all__ = ["KEYS", "OPTICAL", "TRACKS", "TRAFFIC", "TrackSpec"]
