"""Sliding-window admission against a literal replay of the definition."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from promptledger import admissions, admit, demand, quota_state
from promptledger.operators import quota as qt

T0 = datetime(2024, 3, 1)


def frame(spark, hits):
    """hits: (key, seconds, cost[, limit])."""
    rows = [(i, h[0], T0 + timedelta(seconds=h[1]), h[2], h[3] if len(h) > 3 else None) for i, h in enumerate(hits)]
    return spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, cost int, lim int")


def run(spark, hits, **options):
    done = admissions(frame(spark, hits), "k", "ts", "id", "cost", "lim", **options)
    return [r.quota for r in done.orderBy("id").collect()]


def replay(hits, window=60, default=100):
    seen, out = defaultdict(list), {}
    for i, (k, s, cost, *lim) in sorted(enumerate(hits), key=lambda h: (h[1][1], h[0])):
        limit = (lim[0] if lim else None) or default
        live = [(t, c) for t, c in seen[k] if t > s - window]
        used = sum(c for _, c in live)
        ok = used + cost <= limit
        if ok:
            live.append((s, cost))
            used += cost
        seen[k], out[i] = live, (ok, used, len(live))
    return [out[i] for i in range(len(hits))]


def test_worked_examples(spark):
    a = run(spark, [("k", 500, 35), ("k", 507, 64), ("k", 509, 2)])
    assert [(q.allowed, q.used, q.remaining, q.request_count) for q in a] == [(True, 35, 65, 1), (True, 99, 1, 2), (False, 99, 1, 2)]
    assert a[2].retry_after_seconds == 500 + 60 - 509 and a[0].limit == 100 and a[0].window_seconds == 60
    b = run(spark, [("k", 3, 71), ("k", 21, 38), ("k", 63.25, 38)])
    assert [q.allowed for q in b] == [True, False, True] and b[2].used == 38
    c = run(spark, [("k", 7, 133), ("j", 7, 100), ("i", 8, 100), ("k", 9, 100)])
    assert [q.allowed for q in c] == [False, True, True, True] and c[0].retry_after_seconds == 60
    edge = run(spark, [("k", 0, 100), ("k", 59.999999, 1), ("k", 60, 1)])
    assert [q.allowed for q in edge] == [True, False, True]


def test_limits_and_costs(spark):
    got = run(spark, [("a", 0, 101, 0), ("b", 0, 500, 1000), ("c", 0, -5, None)])
    assert [(q.allowed, q.limit, q.used) for q in got] == [(False, 100, 0), (True, 1000, 500), (True, 100, 0)]


HITS = st.lists(st.tuples(st.sampled_from("aab"), st.integers(0, 400), st.integers(0, 70)), min_size=1, max_size=120)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(HITS, st.sampled_from([1, 7]))
def test_same_as_replay_for_any_split(spark, hits, partitions):
    got = run(spark, hits, partitions=partitions)
    assert [(q.allowed, q.used, q.request_count) for q in got] == replay(hits)


def test_one_key_in_a_steady_rhythm(spark):
    hits = [("k", s, 10) for s in range(0, 900)] + [("z", s, 30) for s in range(0, 300, 7)]
    got = run(spark, hits, partitions=9)
    assert [(q.allowed, q.used, q.request_count) for q in got] == replay(hits)


def test_no_window_ever_exceeds_its_limit(spark):
    hits = [("k", (i * 37) % 500, 1 + i % 29) for i in range(400)]
    done = admissions(frame(spark, hits), "k", "ts", "id", "cost", "lim", partitions=3)
    kept = demand(done.filter("quota.allowed"), "k", "ts", "id", "cost", 60)
    assert kept.agg(F.max("demand")).first()[0] <= 100


def test_peek_and_reset(spark):
    done = admissions(frame(spark, [("k", 10, 25), ("j", 10, 5)]), "k", "ts", "id", "cost", "lim")
    keys = spark.createDataFrame([("k", None), ("j", 40), ("x", 0)], "k string, rate_limit int")
    at = T0 + timedelta(seconds=20)

    def state(as_of, resets=None):
        df = quota_state(qt.admitted_entries(done), keys, as_of, key="k", resets=resets)
        return {r.k: r for r in df.collect()}

    now = state(at)
    assert (now["k"].used, now["k"].remaining, now["k"].reset_in_seconds) == (25, 75, 50.0)
    assert (now["j"].limit, now["j"].remaining, now["x"].limit, now["x"].used) == (40, 35, 100, 0)
    assert state(T0 + timedelta(seconds=70))["k"].used == 0
    one = spark.createDataFrame([("k", T0 + timedelta(seconds=15))], "k string, reset_at timestamp_ntz")
    assert {k: r.used for k, r in state(at, one).items()} == {"k": 0, "j": 5, "x": 0}
    both = spark.createDataFrame([(None, T0 + timedelta(seconds=15))], "k string, reset_at timestamp_ntz")
    assert {r.used for r in state(at, both).values()} == {0}


def test_admit_keeps_all_rows(spark):
    df = frame(spark, [("k", 0, 60), (None, 0, 60), ("k", 1, 60)])
    got = {r.id: r.quota for r in admit(df, "k", "ts", "id", "cost").collect()}
    assert got[1] is None and got[0].allowed and not got[2].allowed
    waits = admit(df, "k", "ts", "id", "cost").select("id", qt.retry_after(F.col("quota")).alias("w")).orderBy("id").collect()
    assert [r.w for r in waits] == [None, None, 59]


def test_demand_counts_rejected_requests(spark):
    df = frame(spark, [("k", 0, 80), ("k", 30, 80), ("k", 60, 5), ("j", 60, 1)])
    assert [r.demand for r in demand(df, "k", "ts", "id", "cost", 60).orderBy("id").collect()] == [80, 160, 85, 1]
    with pytest.raises(Exception):
        demand(df, "missing", "ts", "id", "cost", 60).collect()


def test_deciding_runs_no_job_of_its_own(spark):
    tracker = spark.sparkContext.statusTracker()
    hits = frame(spark, [("k", s, 10) for s in range(300)])
    before = len(tracker.getJobIdsForGroup())
    for partitions in (1, 50):
        admissions(hits, "k", "ts", "id", "cost", "lim", partitions=partitions)
    assert len(tracker.getJobIdsForGroup()) == before


def test_quiet_keys_are_many_runs_and_busy_ones_are_one(spark):
    hits = [("quiet", s, 1) for s in range(0, 1200, 5)] + [("busy", s, 9) for s in range(0, 1200, 2)]
    df = frame(spark, hits).selectExpr("k", "unix_micros(cast(ts as timestamp)) as us", "cast(cost as bigint) as cost", "100 as lim")
    runs = qt._runs(df.withColumn("slice", F.expr("us div 60000000"))).groupBy("k").agg(F.countDistinct("run").alias("n")).collect()
    assert {r.k: r.n for r in runs} == {"quiet": 20, "busy": 1}
    assert [(q.allowed, q.used, q.request_count) for q in run(spark, hits, partitions=5)] == replay(hits)
