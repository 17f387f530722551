"""Filters, buckets, percentiles and paging beyond what the SQL comparison covers."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from promptledger.functions.text import bucket_minutes, nearest_rank
from promptledger.operators import audit_log as log, dashboard as db
from verification.views import AS_OF, view

NOW = datetime(2024, 3, 1, 12, 34, 56)
TXN = ("id long, transaction_id string, timestamp timestamp_ntz, masked_api_key string, target_model string, status string, "
       "processing_time_ms double, total_tokens int, redaction_count int, pii_detected boolean, injection_detected boolean, "
       "threat_type string, masked_ip string, pii_types string, prompt_preview string")


def txns(spark, *rows):
    base = dict(masked_api_key="a-****-1", target_model="gpt-4", status="allowed", processing_time_ms=10.0, total_tokens=5, redaction_count=0,
                pii_detected=False, injection_detected=False, threat_type=None, masked_ip="10.0.0.***", pii_types="", prompt_preview="hello")
    return spark.createDataFrame([tuple({"id": i, "transaction_id": f"txn_{i}", "timestamp": NOW, **base, **r}.values()) for i, r in enumerate(rows)], TXN)


def test_empty_store(spark):
    row = db.kpis(txns(spark).limit(0), NOW).first().asDict()
    assert set(row.values()) <= {0, 0.0} and len(row) == 12
    assert db.series(txns(spark), NOW, 15).filter("total = 0 and avg_ms is null and p95_ms is null").count() == 15
    assert log.audit_totals(txns(spark)).first().asDict() == {"total": 0, "pages": 1}
    assert [r.asDict() for r in db.model_usage(txns(spark), NOW).collect()][0] == {"target_model": "gpt-4", "allowed": 0, "blocked": 0, "avg_latency_ms": 0.0}


def test_bucket_edges(spark):
    start, width, n = db.chart_window(NOW, 15)
    assert (start, width, n) == (datetime(2024, 3, 1, 12, 20), 1, 15)
    rows = txns(spark, dict(timestamp=start), dict(timestamp=start - timedelta(microseconds=1)), dict(timestamp=start + timedelta(minutes=15)),
                dict(timestamp=start + timedelta(minutes=1)), dict(timestamp=start + timedelta(seconds=59.999999), status="error"))
    got = {r.idx: r for r in db.series(rows, NOW, 15).collect()}
    assert got[0].total == 2 and got[0].throttled == 1 and got[1].total == 1 and sum(r.total for r in got.values()) == 3
    assert got[0].label == "2024-03-01T12:20:00.000Z"
    # Usage has no upper bound, the series has.
    assert db.model_usage(rows, start).first().allowed == 3
    with pytest.raises(ValueError):
        bucket_minutes(61)


def test_nearest_rank_and_rounding(spark):
    for n in (1, 2, 19, 20, 21, 100, 101):
        df = spark.createDataFrame([(float(i),) for i in range(1, n + 1)], "v double")
        assert df.agg(nearest_rank("v", 95)).first()[0] == -(-95 * n // 100)
        rows = txns(spark, *[dict(processing_time_ms=float(i)) for i in range(1, n + 1)])
        assert db.series(rows, NOW, 15).filter("idx = 14").first().p95_ms == -(-95 * n // 100)
    pair = txns(spark, dict(processing_time_ms=6.55), dict(processing_time_ms=12.32), dict(processing_time_ms=None, status="blocked"))
    assert db.kpis(pair, NOW).first().avg_response_time_ms == 9.44


def test_threat_order(spark):
    rows = txns(spark, *[dict(threat_type=t) for t in ("ZZZ", "UNAUTHORIZED_ACCESS", "POLICY_BYPASS", "AAA", "PROMPT_INJECTION", "POLICY_BYPASS")])
    got = [(r.threat_type, r.n) for r in db.threat_distribution(rows, NOW - timedelta(hours=1)).collect()]
    assert got == [("PROMPT_INJECTION", 1), ("POLICY_BYPASS", 2), ("UNAUTHORIZED_ACCESS", 1), ("AAA", 1), ("ZZZ", 1)]


def test_filters(spark):
    rows = txns(spark, dict(prompt_preview="100% sure_thing"), dict(status="blocked", threat_type="POLICY_BYPASS", injection_detected=True),
                dict(pii_detected=True, pii_types="EMAIL,PHONE"), dict(timestamp=datetime(2024, 3, 2)), dict(prompt_preview="back\\slash"))

    def ids(**f):
        return [r.id for r in log.audit_filter(rows, **f).orderBy("id").collect()]

    assert ids() == ids(search="  ") == [0, 1, 2, 3, 4]
    assert ids(search="SURE_THING") == [0] and ids(search="e%d_") == ids(search="E%D_") and ids(search="email,ph") == [2] and ids(search="back\\s") == [4]
    assert ids(threat_type="NONE") == [0, 2, 3, 4] and ids(threat_type="POLICY_BYPASS", injection=True) == [1]
    assert ids(date_to="2024-03-01") == [0, 1, 2, 4] and ids(date_from="2024-03-02") == [3] and ids(date_from="2024-03-02T00:00:00+09:00") == [3]
    assert ids(pii=True) == [2] and ids(pii=False, status="allowed") == [0, 3, 4]
    for bad in ("not-a-date", "2024-13-01", "2024-03-01T99:00"):
        with pytest.raises(ValueError):
            log.audit_filter(rows, date_from=bad)


def test_pages(spark):
    rows = txns(spark, *[dict(timestamp=NOW + timedelta(seconds=i // 2)) for i in range(50)])
    pages = [[r.id for r in log.audit_page(rows, p, 20).collect()] for p in (1, 2, 3)]
    assert sum(pages, []) == list(range(49, -1, -1))
    last = log.audit_page(rows, 1, 20).collect()[-1]
    assert [r.id for r in log.audit_page(rows, 1, 20, after=(last.timestamp, last.id)).collect()] == pages[1]
    for bad in (dict(page=0), dict(page_size=101)):
        with pytest.raises(ValueError):
            log.audit_page(rows, **bad)
    with pytest.raises(ValueError):
        log.recent_threats(rows, 201)


def test_filters_reach_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("status"), "value")
    plan = log.audit_filter(rows, status="error", date_from="2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(event_type,error)" in plan and "GreaterThanOrEqual(ts" in plan
    kpi = db.kpis(view(spark, sf, "transactions_v"), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in kpi
