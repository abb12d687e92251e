"""The queue as a stream: claims, renewals, expiry, retries and restarts against a plain fold."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

from quillspark.streaming import leases

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, at timestamp, robot_id long, reference_id long, kind string, minutes int"


def folded(events, watermark):
    """All changes by state, events in order, then what the watermark lets expire."""
    out, states = Counter(), {}
    ms = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1000)
    for _, at, robot, ref, kind, minutes in sorted(events, key=lambda e: (e[1], e[0])):
        state, made = leases.step(states.get((robot, ref), (-1, "", 0)), ms(at), kind, minutes)
        states[robot, ref] = state
        out.update((robot, ref, a, s, t) for a, s, t in made)
    for (robot, ref), state in states.items():
        out.update((robot, ref, a, s, t) for a, s, t in leases.expire(state, ms(watermark))[1])
    return out


def run(spark, tmp_path, batches):
    """Each batch of events (later ones are younger) is a file that one run of the stream takes in; the next run restarts from the checkpoint."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        leases.run_queue(events, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "0 seconds").awaitTermination()
    rows = spark.read.schema(leases.CHANGES).parquet(str(tmp_path / "out")).selectExpr("robot_id", "reference_id", "attempt", "status", "unix_millis(at)").collect()
    return Counter(map(tuple, rows))


def test_rules_of_one_attempt():
    minute = 60_000
    state, made = leases.step((-1, "", 0), 0, "requested", 0)
    assert state == (0, "pending", 0) and leases.step(state, 1, "requested", 0)[1] == [(0, "refused", 1)]
    assert leases.step(state, 1, "renewed", 5)[1] == [(0, "refused", 1)] == leases.step(state, 1, "claimed", 0)[1]
    state, _ = leases.step(state, 0, "claimed", 10)
    assert state == (0, "processing", 10 * minute) and leases.expire(state, 10 * minute) == (state, [])
    renewed, _ = leases.step(state, 9 * minute, "renewed", 10)
    assert renewed == (0, "processing", 19 * minute)
    assert leases.step(state, 11 * minute, "importing", 0) == ((1, "pending", 0), [(0, "expired", 10 * minute), (1, "pending", 10 * minute), (1, "refused", 11 * minute)])
    done, _ = leases.step(state, minute, "importing", 0)
    assert done == (0, "importing", 0) and leases.expire(done, 10**9) == (done, [])
    assert leases.expire((3, "processing", 5), 6) == ((3, "expired", 0), [(3, "expired", 5)])
    assert leases.step((3, "expired", 0), 7, "requested", 0)[0] == (4, "pending", 0)


def test_a_stream_in_one_and_many_runs_is_the_fold(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["requested", "claimed", "claimed", "renewed", "importing", "indexing", "completed", "failed"]
    events = [(i, START + timedelta(minutes=i // 3), rng.randint(1, 2), rng.randint(1, 4), rng.choice(kinds), rng.choice([5, 15])) for i in range(240)]
    # The last event's time is the watermark that the leases before it expire by.
    end = START + timedelta(days=1)
    events.append((999, end, 9, 9, "requested", 0))
    wanted = folded(events, end)
    assert sum(n for (_, _, _, s, _), n in wanted.items() if s == "expired") > 5
    for name, cuts in (("one", [0, 241]), ("many", [0, 60, 63, 150, 241])):
        assert run(spark, tmp_path / name, [events[a:b] for a, b in zip(cuts, cuts[1:])]) == wanted


def test_query_of_the_events_is_the_fold(spark):
    from quillspark.plans import stream_queries
    from tests.conftest import DATA

    found = stream_queries.lease_stream(spark, f"{DATA}/sf0.001").selectExpr("robot_id", "reference_id", "attempt", "status", "unix_millis(at)").collect()
    rows = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type").collect()
    events = [(i, t, u, i % 4, stream_queries._KINDS[k], 12 * 60) for i, t, u, k in rows]
    assert Counter(map(tuple, found)) == folded(events, max(t for _, t, *_ in events) - timedelta(minutes=10))


def test_leases_of_a_session_far_from_utc(spark, tmp_path):
    """Timers and changes keep to the instants of the events, and no state's events travel as a frame."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        rows = spark.sql("SELECT * FROM VALUES (1L, timestamp_millis(1700000000000), 1L, 1L, 'requested', 60), (2L, timestamp_millis(1700000060000), 1L, 1L, 'claimed', 60), (3L, timestamp_millis(1700018000000), 2L, 1L, 'requested', 60) t(event_id, at, robot_id, reference_id, kind, minutes)")
        rows.coalesce(1).write.parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        leases.run_queue(events, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "0 seconds").awaitTermination()
        found = spark.read.schema(leases.CHANGES).parquet(str(tmp_path / "out")).selectExpr("robot_id", "attempt", "status", "unix_millis(at) AS ms").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    start, lease_end = 1_700_000_000_000, 1_700_003_660_000
    assert sorted(map(tuple, found)) == sorted([(1, 0, "pending", start), (1, 0, "processing", start + 60_000), (1, 0, "expired", lease_end), (1, 1, "pending", lease_end), (2, 0, "pending", start + 18_000_000)])
