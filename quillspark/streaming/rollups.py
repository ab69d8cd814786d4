"""Usage by tenant and hour, and by tenant and day, in append mode on the watermark.

Events are read once: hours are rolled up from them and days from the finished hours, which are
few. Both results are tables that grow by the windows the watermark has passed; a run handles
what came since the last one, so it may be scheduled or restarted at any time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.streaming.streams import session_settings

COUNTS = ("requests", "tokens_in", "tokens_out", "saved", "errors")


@dataclass(frozen=True)
class Taken:
    """Events read by a run, and those of them that came later than the watermark (None: not asked for)."""

    read: int
    late: int | None


def measured(events: DataFrame, before: Column, after: Column, failed: Column) -> DataFrame:
    """Each event with what it adds: tokens in and out, tokens saved (never below 0), errors. Nulls add 0."""
    a, b = (F.coalesce(x.cast("long"), F.lit(0).cast("long")) for x in (before, after))
    out = events.withColumn("tokens_in", a).withColumn("tokens_out", b).withColumn("errors", F.coalesce(failed.cast("long"), F.lit(0).cast("long")))
    return out.withColumn("saved", F.greatest(F.lit(0).cast("long"), F.col("tokens_in") - F.col("tokens_out"))).withColumn("requests", F.lit(1).cast("long"))


def roll_up(rows: DataFrame, tenant: str, time: str, width: str) -> DataFrame:
    """tenant, start, and the sums of a tumbling window; tables and streams alike. A null tenant is a tenant."""
    out = rows.groupBy(tenant, F.window(time, width).alias("w")).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return out.select(tenant, F.col("w.start").alias("start"), *COUNTS)


def run_rollups(events: DataFrame, tenant: str, folder: str, event_id: str | None = None) -> Taken:
    """Adds finished windows to ``folder/hours`` and ``folder/days``.

    ``events`` is a measured stream with a watermark on ``ts``. With ``event_id`` an event that is
    sent again within the watermark counts once, and an event that is itself older than the
    watermark is dropped and counted as late; without, it still counts while its hour is open.
    A day is finished when an hour after it is; an empty stream adds no rows.
    """
    spark = events.sparkSession
    once = events.dropDuplicatesWithinWatermark([event_id]) if event_id else events
    hours = roll_up(once, tenant, "ts", "1 hour")
    with session_settings(spark, {"spark.sql.streaming.numRecentProgressUpdates": "1000000"}):
        run = _append(hours, f"{folder}/hours", f"{folder}/state-hours").recentProgress
    if not run:  # nothing came, so no hour was finished
        return Taken(0, 0 if event_id else None)
    # Hours are written in the order in which they finish, so no hour comes behind this watermark.
    done = spark.readStream.schema(hours.schema).parquet(f"{folder}/hours").withWatermark("start", "0 seconds")
    _append(roll_up(done, tenant, "start", "1 day"), f"{folder}/days", f"{folder}/state-days")
    late = sum(o["numRowsDroppedByWatermark"] for p in run for o in p["stateOperators"] if o["operatorName"] == "dedupeWithinWatermark")
    return Taken(sum(p["numInputRows"] for p in run), late if event_id else None)


def _append(rows: DataFrame, out: str, state: str):
    query = rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return query
