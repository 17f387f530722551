"""Streams give what the batch gives."""

import glob
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from promptledger import admissions, audit, stream_requests
from promptledger.plans.audit import build_rows
from promptledger.streaming import admission, live
from verification import streams
from verification.decisions import CONFIG, key_dimension
from verification.views import view

ONCE = {"availableNow": True}


def in_time_order(df, path, n, by="ts"):
    """Write a frame as n files, each later in time than the one before."""
    rows = df.orderBy(by)
    total = rows.count()
    numbered = rows.rdd.zipWithIndex().map(lambda r: (*r[0], r[1])).toDF(df.schema.add("_i", "long"))
    for i in range(n):
        part = numbered.filter((F.col("_i") >= total * i // n) & (F.col("_i") < total * (i + 1) // n)).drop("_i")
        part.coalesce(1).write.mode("append").parquet(path)


def test_admission_keeps_its_state(spark, sf, tmp_path):
    hits = view(spark, sf, "quota_hits_v")
    src = str(tmp_path / "in")
    in_time_order(hits, src, 3)
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(src)
    done = admission.admit_stream(stream, "k", "ts", "id", "cost", window_s=86_400)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = done.writeStream.option("checkpointLocation", ck).trigger(**ONCE).start(path=out, format="parquet")
    q.awaitTermination(180)
    assert q.lastProgress["batchId"] >= 2
    got = spark.read.parquet(out).select("id", "k", "ts", "quota")
    want = admissions(hits, "k", "ts", "id", "cost", window_s=86_400).select("id", "k", "ts", "quota")
    assert got.count() == want.count() == 1000
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_whole_audit(spark, sf, tmp_path):
    reqs = view(spark, sf, "requests_v").drop("user_id").withColumn("header_api_key", F.lit(None).cast("string"))
    src, store, ck = (str(tmp_path / d) for d in ("in", "store", "ck"))
    in_time_order(reqs, src, 2)
    keys = key_dimension(spark, sf).checkpoint()
    q = live.start_audit(stream_requests(spark, src, max_files=1), keys, CONFIG, store, ck, ONCE)
    q.awaitTermination(300)
    assert q.exception() is None
    got = spark.read.parquet(f"{store}/transactions").drop("batch_id", "event_date")
    done = audit(reqs, keys, CONFIG)
    want = done.transactions.select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.read.parquet(f"{store}/threat_events").count() == done.threats.count()
    assert spark.read.text(f"{store}/feed").count() == got.count()
    before = got.count()
    ids = [r.id for r in spark.read.parquet(f"{store}/transactions").filter("batch_id = 0").collect()]
    again = done.decided.where(F.col("request_id").isin(ids))
    live.write_batch(again, 0, store)  # a batch that is run a second time
    assert spark.read.parquet(f"{store}/transactions").count() == before
    q = live.start_rejected(stream_requests(spark, src), CONFIG, f"{store}/rejected", f"{ck}-r", ONCE)
    q.awaitTermination(120)
    assert spark.read.parquet(f"{store}/rejected").count() == done.quarantine.count() > 0


def test_feed_and_live_series(spark, sf, tmp_path):
    rows = view(spark, sf, "audit_rows_v")
    src = str(tmp_path / "in")
    in_time_order(rows, src, 2, "timestamp")
    stream = spark.readStream.schema(rows.schema).parquet(src)
    q = live.live_feed(stream, str(tmp_path / "feed"), str(tmp_path / "ck1"), ONCE)
    q.awaitTermination(120)
    assert spark.read.text(str(tmp_path / "feed")).count() == 1000
    counts = live.live_series(stream, width="1 day")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("live").option(
        "checkpointLocation", str(tmp_path / "ck2")).trigger(**ONCE).start()
    q.awaitTermination(120)
    got = {r.bucket_start: (r.total, r.allowed, r.blocked, r.throttled) for r in spark.table("live").collect()}
    want = rows.groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("d")).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "allowed").alias("a"), F.count_if(F.col("status") == "blocked").alias("b"))
    assert got == {r.d: (r.n, r.a, r.b, r.n - r.a - r.b) for r in want.collect()}


def test_live_cells_add_up(spark, tmp_path):
    """Cells of any cut of the rows into batches are those of all rows; a repeated batch and late rows change nothing."""
    from promptledger.operators import dashboard as db

    t0 = datetime(2024, 3, 1)
    rows = [(t0 + timedelta(seconds=7 * i), ("allowed", "allowed", "blocked", "error")[i % 4], ("gpt-4", "llama")[i % 2], i % 13 + 0.125 * (i % 3),
             ["EMAIL"] if i % 3 else []) for i in range(400)]
    ddl = "timestamp timestamp_ntz, status string, target_model string, processing_time_ms double, pii_types array<string>"
    src, out = str(tmp_path / "in"), str(tmp_path / "cells")
    late = [(t0, "allowed", "gpt-4", 9.0, ["SSN"])]
    for part in (rows[:150], rows[150:300], rows[300:], late):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(src)
    batches = []

    def keep(df, i):
        live.keep_cells(df, out, i)
        batches.append(i)
        live.keep_cells(spark.read.parquet(f"{out}/batch_id={i}").cache(), out + "_again", i)

    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    live.live_cells(stream, "5 minutes").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(**ONCE).foreachBatch(
        keep).start().awaitTermination(240)
    held, whole = live.read_cells(spark, out), spark.createDataFrame(rows, ddl)
    assert len(batches) >= 4 and sorted(map(str, held.collect())) == sorted(map(str, live.read_cells(spark, out + "_again").collect()))
    for got, want in ((db.series(held, t0 + timedelta(minutes=47), 60, stats=db.cell_stats), db.series(whole, t0 + timedelta(minutes=47), 60)),
                      (db.cell_model_usage(held, t0), db.model_usage(whole, t0)), (db.cell_pii_distribution(held, t0), db.pii_distribution(whole, t0))):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_recent_buffer(spark, tmp_path):
    path, t0 = str(tmp_path / "recent"), datetime(2024, 3, 1)

    def batch(*ids):
        return spark.createDataFrame([(i, t0 + timedelta(seconds=i)) for i in ids], "id long, timestamp timestamp_ntz")

    def ids():
        return [r.id for r in live.read_recent(spark, path).collect()]

    live.keep_recent(batch(1, 2, 3), path, n=2, batch_id=0)
    assert ids() == [3, 2]
    live.keep_recent(batch(4), path, n=2, batch_id=1)
    live.keep_recent(batch(4), path, n=2, batch_id=1)
    assert ids() == [4, 3]
    live.keep_recent(batch(5, 6, 7), path, n=2, batch_id=2)
    assert ids() == [7, 6]


def test_rows_have_batch_columns(spark, sf):
    reqs = view(spark, sf, "requests_v").drop("user_id")
    assert build_rows(audit(reqs, key_dimension(spark, sf), CONFIG).decided).columns[:3] == ["id", "transaction_id", "timestamp"]


def test_parts_are_read_by_all_slots(spark, tmp_path):
    """A part has as many files as there are slots, each with rows, and the parts stay apart."""
    rows = spark.range(200_000).selectExpr("id", "timestamp_ntz '2024-03-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts")
    stream, folder = streams.parts(rows, "ts", 2, "apart")
    slots = spark.sparkContext.defaultParallelism
    sizes = [r["count"] for r in spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 2 * slots and min(sizes) > 0
    spans = []
    stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(**ONCE).foreachBatch(
        lambda df, i: spans.append(tuple(df.agg(F.min("id"), F.max("id"), F.count("*")).first()))).start().awaitTermination()
    assert spans == [(0, 99_999, 100_000), (100_000, 199_999, 100_000)]


def test_stream_audit_keeps_a_state_partition_per_slot(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    there = set(glob.glob(f"{(spark.sparkContext.getCheckpointDir() or '').removeprefix('file:')}/audit-*"))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert streams.st6(spark, sf).count() > 0
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    made, = set(glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/audit-*")) - there
    kept = [d for d in os.listdir(f"{made}/ck/state/0") if d.isdigit()]
    assert len(kept) == spark.sparkContext.defaultParallelism
