"""Search by trigram postings and deep pages give what scans and sorts give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from promptledger.operators import audit_log as log
from promptledger.sources import search_index as ix, writers

T0 = datetime(2024, 3, 1)
ROWS = "id long, transaction_id string, timestamp timestamp_ntz, status string, masked_ip string, pii_types array<string>, prompt_preview string"


def rows(spark, ids, preview=lambda i: f"Preview number {i:04d} of many", hours=1):
    return spark.createDataFrame([(i, f"txn_{i:06d}", T0 + timedelta(hours=i * hours), "blocked" if i % 3 else "allowed", None if i % 4 else f"10.0.0.{i % 7}",
                                   ["EMAIL"] if i % 5 else ["EMAIL", "PHONE"], preview(i)) for i in ids], ROWS)


@pytest.fixture()
def store(spark, tmp_path):
    path = str(tmp_path / "transactions")
    writers.write_transactions(rows(spark, range(100)).repartition("timestamp"), path)
    assert ix.update_search_index(spark, path) == len(spark.read.parquet(path).inputFiles()) and ix.update_search_index(spark, path) == 0
    return path


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_searches_equal_scans(spark, store):
    writers.write_transactions(rows(spark, range(100, 103), lambda i: "LATE ünïcode 50% \\ back_slash").coalesce(1), store)
    whole = spark.read.parquet(store)
    for search in ("number 0042", "NUMBER 0042", "txn_00001", "0.0.3", "email,pho", "n%0042", "num_er 004", "%", "_", "ab", "  preview number 0007 ", "nowhere to be found",
                   "late", "ÜNÏ", "50%", "\\ back", "0042 of%many", "allowed", "blocked"):
        assert ids(ix.search_store(spark, store, search)) == ids(log.audit_filter(whole, search=search)), search
    some = dict(status="blocked", date_from="2024-03-02", date_to="2024-03-03")
    assert ids(ix.search_store(spark, store, "number 00", **some)) == ids(log.audit_filter(whole, search="number 00", **some))
    assert ix.search_store(spark, store, "nowhere to be found").columns == whole.columns
    # A file written since is read though it has no postings yet, and then gets them.
    late = [f for f in ix.search_files(spark, store, "zzz zzz")]
    assert len(late) == 1 and ix.update_search_index(spark, store) == 1 and ix.search_files(spark, store, "zzz zzz") == []


def test_a_search_reads_few_files(spark, store):
    files = len(spark.read.parquet(store).inputFiles())
    chosen = ix.search_store(spark, store, "number 0042")
    assert len(chosen.inputFiles()) < files / 3 and ids(chosen) == [42]
    assert ix.search_files(spark, store, "ab") is None
    assert ix.pieces_of(" Ab%cdef_gh ") == ["cde", "def"] and ix.pieces_of("a_b%") == []


@pytest.mark.parametrize("hours", [1, 0])
def test_deep_pages(spark, tmp_path, hours):
    path = str(tmp_path / "log")
    writers.write_transactions(rows(spark, range(150), hours=hours), path)
    matches = log.audit_filter(spark.read.parquet(path), status="blocked")
    for page, size in ((1, 7), (2, 7), (9, 11), (10, 10), (14, 7), (15, 7), (16, 7), (400, 20)):
        want = [r.id for r in log.audit_page(matches, page, size).collect()]
        assert [r.id for r in ix.deep_page(matches, page, size).collect()] == want, (page, size)
    if hours:
        plan = ix.deep_page(matches, 9, 5)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in plan
    with pytest.raises(ValueError):
        ix.deep_page(matches, 0)
    untimed = rows(spark, range(5)).withColumn("timestamp", F.when(F.col("id") > 1, F.col("timestamp")))
    assert [r.id for r in ix.deep_page(untimed, 2, 3).collect()] == [r.id for r in log.audit_page(untimed, 2, 3).collect()] == [1, 0]
