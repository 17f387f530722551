"""Search, filter and page the audit tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SEARCHED = ("transaction_id", "masked_api_key", "target_model", "threat_type", "masked_ip", "status", "pii_types",
            "prompt_preview")
MAX_PAGE, MAX_THREATS, MAX_SEARCH = 100, 200, 100


def parse_bound(value: str | None, end: bool = False) -> datetime | None:
    """A date covers its whole day; a longer value is a date-time whose offset is dropped, not applied."""
    if not value:
        return None
    try:
        if len(value) == 10:
            day = datetime.combine(date.fromisoformat(value), datetime.min.time())
            return day + timedelta(days=int(end))
        return datetime.fromisoformat(value.replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        raise ValueError(f"invalid date: {value}") from None


def search_condition(df: DataFrame, text: str) -> Column:
    """Case-insensitive substring over the searched columns the frame has; `%` and `_` are wildcards."""
    like = "%" + text.strip().replace("\\", "\\\\") + "%"
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    cols = [F.array_join(n, ",") if kinds[n] == "array" else F.col(n) for n in SEARCHED if n in kinds]
    return reduce(Column.__or__, [c.ilike(like) for c in cols])


def audit_filter(txns: DataFrame, *, search: str | None = None, status: str | None = None, model: str | None = None,
                 threat_type: str | None = None, date_from: str | None = None, date_to: str | None = None,
                 pii: bool | None = None, injection: bool | None = None) -> DataFrame:
    """All given conditions together; time bounds also prune day folders when the table has them."""
    conds = []
    if search:
        if len(search) > MAX_SEARCH:
            raise ValueError(f"search takes at most {MAX_SEARCH} characters")
        conds.append(search_condition(txns, search))
    if status:
        conds.append(F.col("status") == status)
    if model:
        conds.append(F.col("target_model") == model)
    if threat_type:
        threat = F.col("threat_type")
        conds.append(threat.isNull() if threat_type == "NONE" else threat == threat_type)
    low, high = parse_bound(date_from), parse_bound(date_to, end=True)
    by_day = "event_date" in txns.columns
    if low is not None:
        conds.append(F.col("timestamp") >= F.lit(low).cast("timestamp_ntz"))
        if by_day:
            conds.append(F.col("event_date") >= F.lit(low.date()))
    if high is not None:
        conds.append(F.col("timestamp") < F.lit(high).cast("timestamp_ntz"))
        if by_day:
            conds.append(F.col("event_date") <= F.lit(high.date()))
    if pii is not None:
        conds.append(F.col("pii_detected") == F.lit(pii))
    if injection is not None:
        conds.append(F.col("injection_detected") == F.lit(injection))
    return txns.filter(reduce(Column.__and__, conds)) if conds else txns


def audit_page(df: DataFrame, page: int = 1, page_size: int = 20, after: tuple | None = None) -> DataFrame:
    """A page, newest first. For deep pages pass the last row's (timestamp, id) as `after` instead of a number."""
    if page < 1 or not 1 <= page_size <= MAX_PAGE:
        raise ValueError(f"page starts at 1, page_size is 1..{MAX_PAGE}")
    newest = [F.desc("timestamp"), F.desc("id")]
    if after is not None:
        ts, last_id = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        df = df.filter((F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("id") < last_id)))
    ordered = df.orderBy(*newest)
    return (ordered.offset((page - 1) * page_size) if page > 1 else ordered).limit(page_size)


def audit_totals(df: DataFrame, page_size: int = 20) -> DataFrame:
    """Matching rows and pages; an empty result still has one page."""
    total = F.count("*")
    return df.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / page_size)).cast("long").alias("pages"))


def recent_threats(threats: DataFrame, n: int = 20) -> DataFrame:
    """The latest threat events, rules as a list."""
    if not 1 <= n <= MAX_THREATS:
        raise ValueError(f"n is 1..{MAX_THREATS}")
    top = threats.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)
    if "matched_rules" in top.columns and top.schema["matched_rules"].dataType.typeName() == "string":
        top = top.withColumn("matched_rules", F.filter(F.split("matched_rules", ","), lambda r: r != ""))
    return top


def with_transaction(threats: DataFrame, txns: DataFrame) -> DataFrame:
    """Threat events with status and model of their transaction."""
    extra = [c for c in txns.columns if c not in threats.columns]
    return threats.join(txns.select("transaction_id", *extra), "transaction_id")


def blocked_without_event(txns: DataFrame, threats: DataFrame) -> DataFrame:
    """Blocked transactions that no event explains; a consistent store has none."""
    return txns.filter(F.col("status") == "blocked").join(
        threats.select("transaction_id"), "transaction_id", "left_anti")
