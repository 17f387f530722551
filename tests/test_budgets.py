"""Stream budgets in the order of request time."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from promptledger import admissions
from promptledger.streaming import budgets

T0 = datetime(2024, 3, 1)
HITS = "id long, k string, ts timestamp_ntz, cost int, note string"


@pytest.fixture()
def log(spark, tmp_path):
    """Files of requests, a micro-batch each: (id, key, seconds, cost)."""
    def write(batch, name="in"):
        rows = [(i, k, T0 + timedelta(seconds=s), c, f"n{i}") for i, k, s, c in batch]
        spark.createDataFrame(rows, HITS).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def stream(name="in", schema=HITS):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    def run(frame, name="out"):
        q = frame.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(availableNow=True).start(
            path=str(tmp_path / name), format="parquet")
        q.awaitTermination(240)
        assert q.exception() is None
        return spark.read.parquet(str(tmp_path / name)), str(tmp_path / f"{name}-ck")

    return write, stream, run


def test_order_late_rows_and_idle_state(spark, log):
    write, stream, run = log
    write([(1, "a", 50, 60), (2, "a", 10, 50), (3, None, 0, 5)])
    write([(4, "a", 55, 30), (5, "b", 100, 7), (6, "a", 20, 20)])  # 6 is shuffled, not late
    write([(7, "a", 30, 1), (8, "b", 101, 500)])  # 7 comes behind the clock: 100 - 60 > 30
    write([(9, None, 10_000, 0)])
    done = budgets.admit_in_order(stream(), "k", "ts", "id", "cost", lateness_s=60, window_s=60)
    rows, ck = run(done)
    got = {r.id: r for r in rows.collect()}
    assert sorted(got) == list(range(1, 10)) and {i for i, r in got.items() if r.late} == {7}
    assert {i for i, r in got.items() if r.quota is None} == {3, 7, 9} and all(r.note == f"n{i}" for i, r in got.items())
    assert {i: r.quota.allowed for i, r in got.items() if r.quota} == {1: False, 2: True, 4: True, 5: True, 6: True, 8: False}
    assert got[4].quota.used == 100 and got[1].ts == T0 + timedelta(seconds=50)
    # Every key has been idle for longer than the window: nothing is left.
    assert budgets.live_entries(spark, ck).count() == 0 and budgets.waiting(spark, ck).count() == 0


def test_keys_share_buckets(spark, log, tmp_path):
    """One call decides many keys; each key has its own window, resets and opening entries all the same."""
    write, stream, run = log
    keys = [f"k{i}" for i in range(20)]
    write([(i, k, 10, 60) for i, k in enumerate(keys)])
    write([(100 + i, k, 30, 60) for i, k in enumerate(keys)] + [(200, None, 40, 0)])
    write([(300 + i, k, 80 + i, 90) for i, k in enumerate(keys)])
    write([(400, None, 10_000, 0)])
    opening = spark.createDataFrame([("k3", T0, 50), ("k4", T0, 10)], "k string, ts timestamp_ntz, cost int")
    resets = spark.createDataFrame([("k5", T0 + timedelta(seconds=20))], "k string, reset_at timestamp_ntz")
    resets.write.parquet(str(tmp_path / "resets"))
    frees = spark.readStream.schema(resets.schema).parquet(str(tmp_path / "resets"))
    rows, ck = run(budgets.admit_in_order(stream(), "k", "ts", "id", "cost", lateness_s=5, window_s=60, resets=frees, opening=opening, buckets=1))
    got = {r.id: r.quota.allowed for r in rows.collect() if r.quota}
    assert {i for i, ok in got.items() if not ok and i < 100} == {3} and {i for i, ok in got.items() if ok and 100 <= i < 200} == {105}
    assert all(got[300 + i] == (i != 5) for i in range(20)) and len(got) == 60
    assert budgets.live_entries(spark, ck).count() == 0 and budgets.waiting(spark, ck).count() == 0


def test_peek_while_requests_wait(spark, log):
    write, stream, run = log
    write([(1, "a", 10, 40), (2, "b", 20, 30), (3, "a", 80, 25)])
    write([(4, "a", 95, 5), (5, None, 100, 0)])
    _, ck = run(budgets.admit_in_order(stream(), "k", "ts", "id", "cost", lateness_s=10, window_s=60))
    # The clock stands at 90: 4 waits, and of what is decided only 3 still counts.
    assert [(r.key, r.order, r.cost, r.reset) for r in budgets.waiting(spark, ck).collect()] == [("a", 4, 5, False)]
    keys = spark.createDataFrame([("a", None), ("b", 300), ("c", 0)], "key string, rate_limit int")
    state = {r.key: (r.limit, r.used, r.request_count, r.reset_in_seconds) for r in budgets.peek(
        spark, ck, keys, T0 + timedelta(seconds=90), window_s=60).collect()}
    assert state == {"a": (100, 25, 1, 50.0), "b": (300, 0, 0, 0.0), "c": (100, 0, 0, 0.0)}
    # The stream goes on from where it was; asking has consumed nothing.
    write([(6, "a", 130, 70), (7, None, 900, 0)])
    rows, _ = run(budgets.admit_in_order(stream(), "k", "ts", "id", "cost", lateness_s=10, window_s=60))
    assert {r.id: (r.quota.allowed, r.quota.used) for r in rows.where("quota is not null").collect()}[6] == (True, 100)


def test_resets_and_opening_state(spark, log, tmp_path):
    write, stream, run = log
    opening = spark.createDataFrame([("a", T0 + timedelta(seconds=s), c) for s, c in ((-50, 60), (-70, 99), (-1, 30))] +
                                    [("gone", T0 - timedelta(days=1), 100)], "k string, ts timestamp_ntz, cost int")
    write([(1, "a", 1, 20), (2, "a", 15, 60), (3, "b", 20, 90), (4, "a", 30, 40)])
    write([(5, "b", 30, 80), (6, "b", 40, 90), (7, None, 2000, 0)])
    resets = [("b", 30), (None, 35), ("a", 3000)]  # the request at 30 comes first, then its reset
    spark.createDataFrame([(k, T0 + timedelta(seconds=s)) for k, s in resets], "k string, reset_at timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "resets"))
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    done = budgets.admit_in_order(stream(), "k", "ts", "id", "cost", lateness_s=5, window_s=60, opening=opening,
                                  resets=stream("resets", "k string, reset_at timestamp_ntz"), all_keys=keys)
    rows, ck = run(done)
    got = {r.id: (r.quota.allowed, r.quota.used) for r in rows.where("quota is not null").collect()}
    assert got == {1: (False, 90), 2: (True, 90), 3: (True, 90), 4: (False, 90), 5: (False, 90), 6: (True, 90)}
    assert budgets.live_entries(spark, ck).count() == 0  # the opening entries of an unknown key have left as well
    assert [(r.key, r.reset) for r in budgets.waiting(spark, ck).collect()] == [("a", True)]


def test_stream_equals_one_fold(spark, log):
    import random
    rng = random.Random(4)
    hits = [(i, f"k{rng.randint(0, 4)}", rng.randint(0, 900), rng.randint(0, 60)) for i in range(300)]
    write, stream, run = log
    delayed = sorted(hits, key=lambda h: h[2] + rng.randint(0, 99))
    for at in range(0, 300, 100):
        write(delayed[at:at + 100])
    write([(999, None, 10_000, 0)])
    rows, _ = run(budgets.admit_in_order(stream(), "k", "ts", "id", "cost", lateness_s=100, window_s=60))
    assert rows.where("late").count() == 0
    batch = spark.createDataFrame([(i, k, T0 + timedelta(seconds=s), c, "") for i, k, s, c in hits], HITS)
    want = admissions(batch, "k", "ts", "id", "cost", window_s=60).select("id", "k", "ts", "quota")
    got = rows.where(F.col("quota").isNotNull()).select("id", "k", "ts", "quota")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
