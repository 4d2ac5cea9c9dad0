"""Alarm and clear events of a stream of results, from keyed state.

Ports are dealt into buckets.  A bucket keeps the critical ports of its newest cycles; every cycle's time also goes
to every bucket as a marker, so a port that is absent from a cycle is cleared there.  When a cycle comes late, or a
row of a cycle that was seen before, the events that followed are worked out again: those that no longer hold are
withdrawn (``change`` -1) and the right ones sent (+1).  ``standing`` nets what was sent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from portvigil.functions.times import epoch_micros
from portvigil.operators.alarms import CLEARED
from portvigil.operators.reports import filter_critical
from portvigil.spec import KEYS
from portvigil.streaming.state import to_parquet

BUCKETS = 64
#: Cycles that a bucket remembers; an older one that comes late changes nothing.
CYCLES_KEPT = 96
EVENT = "type string, event_time timestamp_ntz, ip_addr string, slot_id int, port_id int, severity string, message string"
EVENT_COLUMNS = ["type", "event_time", "ip_addr", "slot_id", "port_id", "severity", "message"]

#: Of a cycle: label and reason of every critical port.
Cycle = dict[tuple[str, int, int], tuple[str | None, str | None]]


def events_of(cycles: dict[int, Cycle]) -> set[tuple]:
    """All events of some cycles, by their times: an alarm for every critical port, a clear where it is so no more."""
    found, before = set(), {}
    for time in sorted(cycles):
        now = cycles[time]
        found |= {("ALARM", time, *port, label, reason) for port, (label, reason) in now.items()}
        found |= {("CLEAR", time, *port, None, CLEARED) for port in before if port not in now}
        before = now
    return found


class TransitionProcessor(StatefulProcessor):
    """Per bucket: the cycles it remembers, in a map from the cycle's time to its critical ports."""

    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cycles = handle.getMapState("cycles", "at long", "ports string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known: dict[int, Cycle] = {}
        for (at,), (ports,) in self.cycles.iterator():
            known[int(at)] = {(ip, cid, lid): (label, reason) for ip, cid, lid, label, reason in json.loads(ports)}
        limit = min(known) if len(known) >= self.kept else None
        now = {at: dict(cycle) for at, cycle in known.items()}
        touched = set()
        for part in rows:
            for at, ip, cid, lid, label, reason in part[["at", *KEYS, "alarm_label", "anomaly_reason"]].itertuples(index=False):
                at = int(at)
                if limit is not None and at < limit:
                    continue
                if at not in now or not pd.isna(ip):
                    touched.add(at)
                cycle = now.setdefault(at, {})
                if not pd.isna(ip):
                    text = [None if pd.isna(x) else x for x in (label, reason)]
                    cycle[ip, int(cid), int(lid)] = (text[0], text[1])
        old, new = events_of(known), events_of(now)
        for at in touched:
            self.cycles.updateValue((at,), (json.dumps([[*p, *v] for p, v in sorted(now[at].items())]),))
        for at in sorted(now)[: -self.kept]:
            self.cycles.removeKey((at,))
        changes = [(*e, 1) for e in new - old] + [(*e, -1) for e in old - new]
        out = pd.DataFrame(changes, columns=[*EVENT_COLUMNS, "change"])
        out["event_time"] = pd.to_datetime(out["event_time"], unit="us")
        yield out

    def close(self) -> None:
        pass


def transition_stream(results: DataFrame, buckets: int = BUCKETS, kept: int = CYCLES_KEPT) -> DataFrame:
    """A stream of results as a stream of changes to its events: event columns and ``change``.

    Rows of a cycle may come in several micro-batches and in any order.  Of rows that repeat a port and time the
    last one counts.  Rows without a time or port are left out.  The times of all cycles are remembered to send
    every marker once: one number per slot of the calendar.
    """
    rows = results.where(F.col("occur_date").isNotNull()).withColumn("at", F.expr(epoch_micros("occur_date")))
    named = " and ".join(f"{k} is not null" for k in KEYS)
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket")
    critical = filter_critical(rows).where(named).select(bucket, "at", *KEYS, "alarm_label", "anomaly_reason")
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    markers = rows.select("at").dropDuplicates(["at"]).select(every, "at")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in critical.schema.fields if f.name not in ("bucket", "at")}
    both = critical.unionByName(markers.withColumns(empty))
    return both.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=TransitionProcessor(kept), outputStructType=f"{EVENT}, change int", outputMode="Append", timeMode="None"
    )


def start(results: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the changes of a stream of results to ``path``."""
    return to_parquet(transition_stream(results), path, checkpoint, **trigger)


def standing(spark: SparkSession, path: str) -> DataFrame:
    """The events that hold: sent and not withdrawn."""
    sent = spark.read.schema(f"{EVENT}, change int").parquet(path)
    return sent.groupBy(*EVENT_COLUMNS).agg(F.sum("change").alias("net")).where("net > 0").drop("net")
