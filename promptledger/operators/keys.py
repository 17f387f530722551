"""The key dimension: authentication, upsert, last use, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.masking import hash_key, mask_key
from ..functions.text import is_blank, to_iso
from ..schemas import DEFAULT_LIMIT


def with_key_identity(requests: DataFrame, secret: str, raw: str = "raw_key") -> DataFrame:
    """Add `key_hash` (null without a key) and `masked_key`; the raw key can be dropped afterwards."""
    none = is_blank(F.col(raw))
    return requests.withColumns({
        "key_hash": F.when(~none, hash_key(F.col(raw), secret)),
        "masked_key": F.when(none, F.lit("****")).otherwise(mask_key(F.col(raw))),
    })


def resolve_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Look up `key_hash` and add `auth_reason` (missing, invalid, revoked; null when valid), name and limit.

    A plain left join: Spark broadcasts the key table while it is under the size threshold and otherwise
    shuffles, with adaptive skew handling for busy keys.
    """
    dim = keys.select("key_hash", F.col("status").alias("_status"), "key_name",
                      F.col("rate_limit").alias("key_limit"))
    reason = (
        F.when(F.col("key_hash").isNull(), "missing").when(F.col("_status").isNull(), "invalid")
        .when(F.col("_status") != "active", "revoked")
    )
    joined = requests.join(dim, "key_hash", "left").withColumn("auth_reason", reason).drop("_status")
    return joined.withColumn("key_hash", F.coalesce("key_hash", F.lit("-")))


def authenticate(requests: DataFrame, keys: DataFrame, secret: str, raw: str = "raw_key") -> DataFrame:
    """Outcome of the key check per request. A missing key has hash `-` and mask `****`."""
    return resolve_keys(with_key_identity(requests, secret, raw), keys)


def new_keys(existing: DataFrame, incoming: DataFrame, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The incoming keys whose hash is not there yet, with the default limit where none (or 0) is given.

    A hash that comes in twice is taken once, with its lowest id.
    """
    if "id" in incoming.columns:
        one = F.min_by(F.struct(*incoming.columns), F.col("id")).alias("_key")
        incoming = incoming.groupBy("key_hash").agg(one).select("_key.*")
    else:
        incoming = incoming.dropDuplicates(["key_hash"])
    fresh = incoming.join(existing.select("key_hash"), "key_hash", "left_anti")
    return fresh.withColumn("rate_limit", F.coalesce(F.when(F.col("rate_limit") != 0, F.col("rate_limit")),
                                                     F.lit(default_limit)).cast("int"))


def upsert_keys(existing: DataFrame, incoming: DataFrame, default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    return existing.unionByName(new_keys(existing, incoming, default_limit), allowMissingColumns=True)


def touch_keys(keys: DataFrame, valid_requests: DataFrame, ts: str = "ts") -> DataFrame:
    """Move `last_used_at` to the latest authenticated request, throttled and blocked ones included."""
    used = valid_requests.groupBy("key_hash").agg(F.max(ts).alias("_used"))
    return keys.join(used, "key_hash", "left").withColumn(
        "last_used_at", F.greatest("last_used_at", "_used")).drop("_used").select(*keys.columns)


def list_keys(keys: DataFrame) -> DataFrame:
    """Keys in id order, masked fields only."""
    return keys.orderBy("id").select(
        "key_name", "masked_key", "status", "rate_limit", to_iso(F.col("created_at")).alias("created_at"),
        to_iso(F.col("last_used_at")).alias("last_used_at"))
