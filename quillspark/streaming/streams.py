"""Request streams: limits, reuse, repeats and rollups on event time.

Keyed operators sort the rows of a micro-batch by (ts, event_id) before they touch state; a row
that is late by more than a batch is handled when it comes, against the state of that moment.
Idle keys leave the state by a timeout on the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions import patterns as P
from quillspark.functions.measures import requires_exact_output, token_count
from quillspark.operators.rewrite import compact_text
from quillspark.sources.folders import scratch_folder


def read_requests(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """A stream over a folder of events, or over one file; ts becomes a timestamp, which watermarks need."""
    table = spark.read.parquet(path)
    reader, (folder, _, name) = spark.readStream.schema(table.schema), path.rstrip("/").rpartition("/")
    if any(f.endswith(f"/{name}") for f in table.inputFiles()):  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", name), folder
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def limit_of(base: Column | int, tier: str | Column = "default") -> Column:
    """max(1, floor(base * multiplier)); a blocked tenant has none."""
    t = F.lit(tier) if isinstance(tier, str) else tier
    factor = F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in P.TIERS.items()], F.lit(1.0))
    return F.when(factor == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.lit(base) * factor))).cast("int")


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")


def _timed(stream: DataFrame) -> DataFrame:
    """``ms``, the nearest millisecond of ts, counted in whole microseconds and in any session's time zone."""
    return stream.withColumn("ms", F.expr("(unix_micros(ts) + 500) div 1000"))


def _keep(state: GroupState, value: tuple, until_ms: int) -> None:
    state.update(value)
    mark = state.getCurrentWatermarkMs()
    state.setTimeoutTimestamp(max(until_ms, mark + 1))


def limit_rows(times_ms: list[int], limits: list[int], count: int, reset_ms: int, period_ms: int):
    """The limiter itself: (allowed, retry seconds) for each request, and the state after."""
    out = []
    for t, limit in zip(times_ms, limits, strict=True):
        if limit == 0:
            out.append((False, period_ms // 1000))
        elif reset_ms <= t:
            count, reset_ms = 1, t + period_ms
            out.append((True, 0))
        elif count >= limit:
            out.append((False, max(1, -(-(reset_ms - t) // 1000))))
        else:
            count += 1
            out.append((True, 0))
    return out, count, reset_ms


def rate_limit(stream: DataFrame, keys: list[str], period_s: int = P.PERIOD_SECONDS) -> DataFrame:
    """stream(keys, event_id, ts, limit): a window opens with a key's first request after the last
    one closed; requests beyond the limit are denied with the seconds to wait."""
    period = period_s * 1000

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(frames)
        count, reset = state.get if state.exists else (0, 0)
        found, count, reset = limit_rows(rows["ms"].tolist(), rows["limit"].tolist(), count, reset, period)
        _keep(state, (count, reset), reset)
        out = rows[["event_id"]].copy()
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        out["allowed"], out["retry_after_s"] = [x[0] for x in found], [x[1] for x in found]
        yield out[[*keys, "event_id", "allowed", "retry_after_s"]]

    types = dict(stream.dtypes)
    ddl = ", ".join(f"{k} {types[k]}" for k in keys) + ", event_id long, allowed boolean, retry_after_s long"
    return _timed(stream).groupBy(*keys).applyInPandasWithState(run, ddl, "count long, reset long", "append", GroupStateTimeout.EventTimeTimeout)


def reuse_rows(times_ms: list[int], bypass: list[bool], stored_ms: int, ttl_ms: int):
    """hit, miss or bypass for each request; a hit does not renew the stored answer."""
    out = []
    for t, skip in zip(times_ms, bypass, strict=True):
        if skip:
            out.append("bypass")
        elif stored_ms >= 0 and t < stored_ms + ttl_ms:
            out.append("hit")
        else:
            stored_ms = t
            out.append("miss")
    return out, stored_ms


def request_key(route: Column, tenant: Column, body: Column, version: str = "v1") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(version), route, tenant.cast("string"), F.coalesce(F.to_json(F.try_parse_json(body)), body)), 256)


def reuse_within_ttl(stream: DataFrame, key: str, ttl_s: int) -> DataFrame:
    """stream(key, event_id, ts, no_store): hit within ``ttl_s`` of the time stored, else miss."""
    ttl = ttl_s * 1000

    def run(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(frames)
        found, stored = reuse_rows(rows["ms"].tolist(), rows["no_store"].tolist(), state.get[0] if state.exists else -1, ttl)
        _keep(state, (stored,), stored + ttl)
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"].tolist(), "outcome": found})

    return _timed(stream).groupBy(key).applyInPandasWithState(run, f"{key} string, event_id long, outcome string", "stored long", "append", GroupStateTimeout.EventTimeTimeout)


def repeat_tracker(stream: DataFrame, key: str, output: str, idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """Running repeat count of each key, and whether its output equals the one before."""

    def run(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(frames)
        n, last = state.get if state.exists else (0, None)
        nth, same = [], []
        for x in rows[output]:
            n += 1
            nth.append(n)
            same.append(None if n == 1 else bool(x == last))
            last = x
        _keep(state, (n, last), int(rows["ts"].max().timestamp() * 1000) + idle_ms)
        yield pd.DataFrame({key: k[0], "event_id": rows["event_id"].tolist(), "nth": nth, "same_as_previous": pd.array(same, dtype="boolean")})

    types = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {types[key]}, event_id long, nth long, same_as_previous boolean", f"n long, last {types[output]}", "append", GroupStateTimeout.EventTimeTimeout)


def usage_rollup(stream: DataFrame, tenant: str, width: str = "1 day") -> DataFrame:
    """Requests and value by tenant and tumbling window; works on streams and tables alike."""
    w = F.window("ts", width)
    return stream.groupBy(tenant, w).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("value"), F.count_if(F.col("event_type") == "error").alias("errors")).select(tenant, F.col("window.start").alias("start"), "requests", "value", "errors")


def stream_measures(stream: DataFrame, text: str) -> DataFrame:
    """Stateless measures of each request's text."""
    t = F.col(text)
    return stream.withColumn("tokens", token_count(t)).withColumn("exact", requires_exact_output(t)).withColumn("compact_tokens", token_count(compact_text(t)))


@contextmanager
def session_settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for what starts inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into the shared folder, and reads the result back."""
    spark = stream.sparkSession
    folder = scratch_folder(spark, "stream")
    schema = stream.schema
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")
