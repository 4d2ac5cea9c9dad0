"""Alarm and clear events.

A cycle is one slot of results.  A port that is critical in a cycle raises an ALARM; a port that was
critical in the previous cycle and is not now, or is missing, gets a CLEAR at the slot of this cycle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portvigil.functions.times import time_text
from portvigil.operators.reports import filter_critical
from portvigil.spec import ALARM_LIST_SIZE, KEYS

CLEARED = "Alarm cleared"
EVENT_KEYS = ("ip_addr", "slot_id", "port_id")


def _event(kind: str, time: Column, severity: Column, message: Column) -> list[Column]:
    return [
        F.lit(kind).alias("type"),
        time.alias("event_time"),
        F.col("ip_addr"),
        F.col("cid").alias("slot_id"),
        F.col("lid").alias("port_id"),
        severity.cast("string").alias("severity"),
        message.alias("message"),
    ]


def alarm_events(criticals: DataFrame) -> DataFrame:
    return criticals.select(
        *_event("ALARM", F.col("occur_date"), F.col("alarm_label"), F.col("anomaly_reason"))
    )


def clear_events(recovered: DataFrame) -> DataFrame:
    """``recovered`` has the keys and ``cleared_at``."""
    return recovered.select(*_event("CLEAR", F.col("cleared_at"), F.lit(None), F.lit(CLEARED)))


def day_slots(results: DataFrame) -> DataFrame:
    """(day, slots): a day's slots with results in order, then the first slot of the next such day.

    One row per calendar day, each with the slots of a day: bounded by the retention period, whatever the
    number of ports, so it is broadcast.  The unpartitioned window sorts one row per day.
    """
    slots = results.groupBy(F.to_date("occur_date").alias("day"), "occur_date").agg(F.lit(1).alias("one"))
    days = slots.groupBy("day").agg(F.array_sort(F.collect_list("occur_date")).alias("slots"))
    following = F.lead(F.get("slots", F.lit(0))).over(Window.orderBy("day"))
    return days.select("day", F.array_compact(F.concat("slots", F.array(following))).alias("slots"))


def known_alarm_probe(criticals: DataFrame, known: DataFrame) -> DataFrame:
    """Criticals not announced yet: the same port at the same slot is not repeated."""
    return criticals.join(known, [*KEYS, "occur_date"], "left_anti")


def recovered_keys(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Ports critical before and not critical now."""
    return previous.select(*KEYS).join(current, list(KEYS), "left_anti")


def alarm_transitions(results: DataFrame) -> DataFrame:
    """All alarm and clear events of a stored run of cycles.

    A critical row is cleared at the next cycle unless that is also the port's next critical slot.  The next
    cycle is found per day: the slots of a day, at most one per minute, are gathered into one short list per
    day, and a row takes the first later slot of its own day's list, which ends with the first slot of the next
    day that has any.  The results are read once for both, reduced to the critical rows and the days' slots.
    """
    port_line = Window.partitionBy(*KEYS).orderBy("occur_date")
    criticals = filter_critical(results).select("occur_date", *KEYS, "alarm_label", "anomaly_reason")
    followed = criticals.withColumn("next_critical", F.lead("occur_date").over(port_line))
    timed = followed.withColumn("day", F.to_date("occur_date")).join(F.broadcast(day_slots(results)), "day")
    later = F.filter("slots", lambda s: s > F.col("occur_date"))
    timed = timed.withColumn("next_cycle", F.get(later, F.lit(0)))
    alarm = "struct('ALARM' as type, occur_date as event_time, alarm_label as severity, anomaly_reason as message)"
    clear = (
        "case when next_cycle < coalesce(next_critical, timestamp_ntz'9999-12-31 00:00:00') then "
        f"struct('CLEAR' as type, next_cycle as event_time, string(null) as severity, '{CLEARED}' as message) end"
    )
    both = timed.selectExpr(*KEYS, f"explode(array({alarm}, {clear})) as e").where("e is not null")
    return both.selectExpr(
        "e.type", "e.event_time", "ip_addr", "cid as slot_id", "lid as port_id", "e.severity", "e.message"
    )


def alarm_step(open_: DataFrame, current: DataFrame) -> DataFrame:
    """Events of one cycle, given the open alarms before it (keys and ``occur_date``)."""
    now = filter_critical(current)
    alarms = known_alarm_probe(now, open_)
    at = current.agg(F.max("occur_date").alias("at")).scalar()
    # an alarm is never cleared before the slot it was raised for
    earlier = open_.where(F.col("occur_date") <= at)
    recovered = recovered_keys(earlier, now).withColumn("cleared_at", at)
    return alarm_events(alarms).unionByName(clear_events(recovered))


def alarm_json(events: DataFrame) -> DataFrame:
    """The message sent for each event; fields without a value are left out."""
    fields = ["type", F.expr(time_text("event_time")).alias("event_time"), *EVENT_KEYS, "severity", "message"]
    return events.select("type", "event_time", *EVENT_KEYS, F.to_json(F.struct(*fields)).alias("value"))


def latest_event(events: DataFrame) -> DataFrame:
    """The newest event of each port; the maximum combines before the shuffle."""
    rest = [F.col(c) for c in ("type", "severity", "message")]
    newest = F.max(F.struct("event_time", *rest)).alias("e")
    return events.groupBy(*EVENT_KEYS).agg(newest).select(
        "e.type", "e.event_time", *EVENT_KEYS, "e.severity", "e.message"
    )


def active_alarm_view(events: DataFrame) -> DataFrame:
    """Open alarms: an ALARM replaces the port's entry, a CLEAR removes it."""
    return latest_event(events).where(F.col("type") == "ALARM")


def top_alarms(events: DataFrame, keep: int = ALARM_LIST_SIZE) -> DataFrame:
    """The newest alarm of each port, newest first, as long as the alarm list."""
    newest = latest_event(events.where(F.col("type") == "ALARM"))
    return newest.orderBy(F.desc("event_time"), *EVENT_KEYS).limit(keep)
