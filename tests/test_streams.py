"""Streams against plain loops, and exports with a wrong version."""

import pytest

from quillspark.plans import q_streams
from quillspark.sources import corpus
from quillspark.streaming.streams import limit_rows, reuse_rows


def events(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/events.parquet").collect()]
    for r in rows:
        r["ms"] = int((r["ts"] - __import__("datetime").datetime(1970, 1, 1)).total_seconds() * 1000)
    return sorted(rows, key=lambda r: (r["ts"], r["event_id"]))


def test_limiter_windows():
    found, count, reset = limit_rows([0, 10, 20, 60_000, 60_001], [2, 2, 2, 2, 2], 0, 0, 60_000)
    assert [a for a, _ in found] == [True, True, False, True, True] and found[2][1] == 60 and (count, reset) == (2, 120_000)
    assert limit_rows([5], [0], 0, 0, 60_000)[0] == [(False, 60)]


def test_reuse_is_not_renewed_by_hits():
    assert reuse_rows([0, 5, 9, 10, 12], [False, False, True, False, False], -1, 10)[0] == ["miss", "hit", "bypass", "miss", "hit"]


def test_rate_limit_matches_a_loop(spark, sf):
    got = {r.event_id: (r.allowed, r.retry_after_s) for r in q_streams.k1(spark, sf).collect()}
    state, want = {}, {}
    for e in events(spark, sf):
        limit = 0 if e["user_id"] % 10 == 0 else 1 if e["user_id"] % 3 == 0 else 3
        count, reset = state.get((e["user_id"], e["event_type"]), (0, 0))
        found, count, reset = limit_rows([e["ms"]], [limit], count, reset, 86_400_000)
        state[e["user_id"], e["event_type"]] = count, reset
        want[e["event_id"]] = found[0]
    assert got == want


def test_waits_count_from_the_nearest_millisecond(spark, tmp_path):
    """As ``epoch_ms`` does; a cut millisecond would ask for a second less."""
    from pyspark.sql import functions as F

    from quillspark.streaming import streams as S

    rows = [(1, "2024-01-01 00:00:00.000600"), (2, "2024-01-01 00:00:01.000400")]
    spark.createDataFrame(rows, "event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = S.read_requests(spark, f"{tmp_path}/in").select(F.lit("a").alias("key"), "event_id", "ts", F.lit(1).alias("limit"))
    assert {r.event_id: r.retry_after_s for r in S.run_once(S.rate_limit(stream, ["key"], 61)).collect()} == {1: 0, 2: 61}


def test_reuse_matches_a_loop(spark, sf):
    got = {r.event_id: r.outcome for r in q_streams.k2(spark, sf).collect()}
    state, want = {}, {}
    for e in events(spark, sf):
        key = e["event_type"], e["user_id"] % 20
        found, state[key] = reuse_rows([e["ms"]], [e["event_id"] % 50 == 0], state.get(key, -1), 6 * 3_600_000)
        want[e["event_id"]] = found[0]
    assert got == want


def test_exports_of_another_version_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version": "benchmark-export.v1", "records": [{"case_id": "x"}]}')
    with pytest.raises(Exception, match="unsupported schema_version"):
        corpus.read_export(spark, [str(tmp_path)]).collect()


def test_late_rows_are_judged_in_order_over_several_batches(spark, tmp_path):
    """Files are batches; a row that comes late but within the watermark counts at its own time, a later one is dropped."""
    from pyspark.sql import functions as F

    from quillspark.streaming import streams as S
    from quillspark.streaming import timed

    minute = lambda m: f"2024-01-01 {m // 60:02}:{m % 60:02}:00"
    batches = [[(1, "a", 0), (2, "a", 40), (3, "b", 41)], [(4, "a", 20), (5, "a", 60)], [(6, "a", 300)], [(7, "a", 10), (8, "b", 310)], [(9, "z", 1000)], [(10, "z", 1001), (11, "a", 15)]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(e, k, minute(m)) for e, k, m in rows], "event_id long, key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    def run(make):
        # Folders in the order of their names, one at a time.
        stream = spark.readStream.schema("event_id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
        with timed.timed_state(spark):
            return S.run_once(make(stream.withColumn("limit", F.lit(2)).withColumn("no_store", F.lit(False)))).collect()

    found = run(lambda s: timed.timed_rate_limit(s, "key", 3600))
    # a: 0, 10 and 20 (late), 40, 60 (a new hour), 300; event 11 is later than the watermark.
    assert {r.event_id: r.allowed for r in found} == {1: True, 7: True, 4: False, 2: False, 5: True, 6: True, 3: True, 8: True}
    found = run(lambda s: timed.timed_reuse(s, "key", 1800))
    assert {r.event_id: r.outcome for r in found} == {1: "miss", 7: "hit", 4: "hit", 2: "miss", 5: "hit", 6: "miss", 3: "miss", 8: "miss"}
    found = run(lambda s: timed.timed_repeats(s.withColumn("out", F.lit("x")), "key", "out"))
    assert {r.event_id: r.nth for r in found} == {1: 1, 7: 2, 4: 3, 2: 4, 5: 5, 6: 6, 3: 1, 8: 2}


def test_rollups_over_runs_with_late_and_repeated_events(spark, tmp_path):
    """Four runs: what is on time counts once, in its hour and day; what is late is dropped and counted."""
    from collections import Counter

    from pyspark.sql import functions as F

    from quillspark.streaming import rollups as U
    from quillspark.streaming import streams as S

    hour = lambda h: f"2024-01-0{1 + int(h) // 24} {int(h) % 24:02}:{int(h * 60) % 60:02}:00"
    runs = [
        [(1, "a", 0.5), (2, "a", 0.75), (3, None, 1.5), (4, "a", 6)],  # the watermark is now at 4
        [(5, "a", 4.5), (2, "a", 0.75), (6, "b", 3.5), (7, "a", 5), (7, "a", 5), (8, "a", 23.5)],  # 2 and 6 are late, 7 comes twice; at 21.5
        [(9, "b", 22), (10, "a", 30)],  # at 28
        [(11, "b", 27), (12, "a", 60)],  # 11 is late; at 58
    ]
    schema = "event_id long, tenant string, ts timestamp"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withWatermark("ts", "2 hours")
    events = U.measured(stream, F.col("event_id"), F.lit(3), F.col("event_id") % 2 == 0)
    assert U.run_rollups(events, "tenant", f"{tmp_path}/out", "event_id") == U.Taken(0, 0)
    taken = []
    for i, rows in enumerate(runs):
        df = spark.createDataFrame([(e, k, hour(h)) for e, k, h in rows], "event_id long, tenant string, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        taken.append(U.run_rollups(events, "tenant", f"{tmp_path}/out", "event_id"))
    assert taken == [U.Taken(4, 0), U.Taken(6, 2), U.Taken(2, 0), U.Taken(2, 1)]

    good = {e: (k, h) for rows in runs for e, k, h in rows if e not in (6, 11)}
    for name, width, until in (("hours", 1, 58), ("days", 24, 30)):
        want = {c: Counter() for c in U.COUNTS}
        for e, (k, h) in good.items():
            start = h // width * width
            if start + width <= until:
                for c, v in {"requests": 1, "tokens_in": e, "tokens_out": 3, "saved": max(0, e - 3), "errors": 1 - e % 2}.items():
                    want[c][k, hour(start)] += v
        found = spark.read.parquet(f"{tmp_path}/out/{name}").collect()
        assert len(found) == len(want["requests"])
        for c in U.COUNTS:
            assert {(r.tenant, str(r.start)): r[c] for r in found} == dict(want[c]), (name, c)
    free = U.run_rollups(events, "tenant", f"{tmp_path}/free")
    assert free.read == 14 and free.late is None
    with S.session_settings(spark, {"quill.test": "1"}):
        assert spark.conf.get("quill.test") == "1"
    assert spark.conf.get("quill.test", None) is None


def test_waiting_rows_cost_a_call_for_each_piece():
    """5,000 rows of a key in two batches: judged in order up to the watermark, in far fewer calls on the state than rows."""
    from types import SimpleNamespace

    from quillspark.streaming.timed import InOrder

    calls, timers = [], []

    class Kept(dict):
        def __getattr__(self, name):
            def call(*a):
                calls.append(name)
                return {"getValue": lambda: self[a[0]], "updateValue": lambda: self.update({a[0]: a[1]}), "removeKey": lambda: self.pop(a[0]), "containsKey": lambda: a[0] in self, "exists": lambda: 0 in self}[name]()

            return call

        def get(self):
            return self[0]

        def update(self, v):
            super().update(v if isinstance(v, dict) else {0: v})

        def keys(self):
            return list(super().keys())

    handle = SimpleNamespace(getMapState=lambda *_: Kept(), getValueState=lambda *_: Kept(), registerTimer=timers.append)
    p = InOrder(lambda kept, ms, item: ((ms,), ((kept or (0,))[0] + 1,)), "int", "n long", ["key", "event", "ms"], 10)
    p.init(handle)
    rows = [{"ms": i * 7919 % 5000, "event_id": i, "value": i} for i in range(5000)]
    for part in (rows[:2500], rows[2500:]):
        p.handleInputRows(("a",), iter(part), None)
    out = list(p.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 3000), SimpleNamespace(getExpiryTimeInMs=lambda: 1)))
    assert [r.ms for r in out] == list(range(3000)) and 3001 in timers
    out = list(p.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 9000), SimpleNamespace(getExpiryTimeInMs=lambda: 3001)))
    assert [r.ms for r in out] == list(range(3000, 5000)) and len(calls) < 100
