"""Alarm and clear events of a stream of results.

The state is small and written per micro-batch: the slot of the newest cycle seen and the ports critical in it.
Each batch's events are the batch form's transitions over that state followed by the batch, so the outcome does
not depend on how many cycles a batch holds.  All rows of a cycle must come in one batch, as upserts write them.
Rows of cycles that are not newer than the state come too late to change events that were sent; they are written
to a folder of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from portvigil.operators.alarms import alarm_transitions
from portvigil.operators.reports import filter_critical
from portvigil.spec import KEYS
from portvigil.storage import materialized, partition_values

EVENT_SCHEMA = (
    "type string, event_time timestamp_ntz, ip_addr string, slot_id int, port_id int, severity string, message string"
)
#: Rows of the newest cycle: its critical ports, and one row without a port that marks the slot.
STATE_SCHEMA = "occur_date timestamp_ntz, ip_addr string, cid int, lid int, alarm_label string, anomaly_reason string"
_COLUMNS = ("occur_date", *KEYS, "alarm_label", "anomaly_reason")


def _batch_name(batch: int) -> str:
    return f"{batch:012d}"


def alarm_batch(results: DataFrame, path: str, batch: int) -> None:
    """Events of one micro-batch under ``path``; running it again replaces its files."""
    spark = results.sparkSession
    name = _batch_name(batch)
    before = [b for b in partition_values(spark, f"{path}/state", "batch") if b < name]
    state = spark.createDataFrame([], STATE_SCHEMA)
    if before:
        state = spark.read.schema(STATE_SCHEMA).parquet(f"{path}/state/batch={before[-1]}")
    last = state.agg(F.max("occur_date")).first()[0]
    with materialized(results.select(*_COLUMNS), "results") as arrived:
        in_time = F.lit(True) if last is None else F.col("occur_date") > F.lit(last)
        arrived.where(~in_time).write.mode("overwrite").parquet(f"{path}/late/batch={name}")
        fresh = arrived.where(in_time)
        newest = fresh.agg(F.max("occur_date")).first()[0]
        if newest is None:
            return
        events = alarm_transitions(state.unionByName(fresh))
        if last is not None:
            events = events.where((F.col("event_time") > F.lit(last)))  # the state's own alarms were sent
        events.write.mode("overwrite").parquet(f"{path}/events/batch={name}")
        at_newest = fresh.where(F.col("occur_date") == F.lit(newest))
        mark = at_newest.select("occur_date").limit(1)
        kept = filter_critical(at_newest).unionByName(mark, allowMissingColumns=True)
        kept.select(*_COLUMNS).write.mode("overwrite").parquet(f"{path}/state/batch={name}")  # last


def alarm_state_stream(results: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream; ``read_events`` has what it sent."""
    writer = results.writeStream.foreachBatch(lambda batch, number: alarm_batch(batch, path, number))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{path}/events").drop("batch")
