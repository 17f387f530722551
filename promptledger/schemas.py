"""Table schemas and the fixed domains they draw from."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType(),
)

REQUEST_LOG = _struct(
    ("request_id", _L, False), ("ts", _TS, False), ("api_key", _S, True), ("header_api_key", _S, True),
    ("target_model", _S, True), ("prompt", _S, True), ("client_ip", _S, True),
    ("enable_pii", _B, True), ("enable_injection", _B, True),
)

API_KEYS = _struct(
    ("id", _I, False), ("key_hash", _S, False), ("key_name", _S, False), ("masked_key", _S, False),
    ("status", _S, False), ("rate_limit", _I, True), ("created_at", _TS, True), ("last_used_at", _TS, True),
)

TRANSACTIONS = _struct(
    ("id", _L, False), ("transaction_id", _S, False), ("timestamp", _TS, False), ("api_key_hash", _S, False),
    ("masked_api_key", _S, False), ("target_model", _S, False), ("input_tokens", _I, False),
    ("output_tokens", _I, False), ("total_tokens", _I, False), ("processing_time_ms", _D, False),
    ("llm_latency_ms", _D, False), ("status", _S, False), ("http_status", _I, False),
    ("pii_detected", _B, False), ("pii_redacted", _B, False), ("redaction_count", _I, False),
    ("pii_types", T.ArrayType(_S), False), ("injection_detected", _B, False), ("threat_type", _S, True),
    ("risk_level", _S, True), ("masked_ip", _S, False), ("prompt_preview", _S, False),
)

THREAT_EVENTS = _struct(
    ("id", _L, False), ("transaction_id", _S, False), ("timestamp", _TS, False), ("threat_type", _S, False),
    ("risk_level", _S, False), ("action", _S, False), ("masked_ip", _S, False), ("masked_api_key", _S, False),
    ("matched_rules", T.ArrayType(_S), False),
)

INJECTION_RULES = _struct(
    ("name", _S, True), ("pattern", _S, True), ("threat_type", _S, True), ("risk_level", _S, True),
    ("weight", _D, True),
)

RESPONSE_LOG = _struct(
    ("request_id", _L, False), ("text", _S, True), ("latency_ms", _D, True), ("output_tokens", _I, True),
    ("error", _S, True),
)

ATTEMPT_LOG = _struct(
    ("request_id", _L, False), ("attempt", _I, False), ("model", _S, False), ("ok", _B, False),
    ("text", _S, True), ("output_tokens", _I, True), ("error", _S, True),
)

STAGE_LOG = _struct(
    ("transaction_id", _S, False), ("seq", _I, False), ("stage", _S, False), ("status", _S, False),
    ("ts", _TS, False),
)

QUOTA_TYPE = _struct(
    ("allowed", _B, False), ("limit", _I, False), ("used", _L, False), ("remaining", _L, False),
    ("request_count", _I, False), ("window_seconds", _I, False), ("reset_in_seconds", _D, False),
    ("retry_after_seconds", _I, False),
)

# Domains, display orders and display names.
STATUSES = ("allowed", "blocked", "rate_limited", "unauthorized", "forbidden", "error")
THREAT_CATEGORIES = (
    "PROMPT_INJECTION", "SYSTEM_PROMPT_EXFILTRATION", "CREDENTIAL_EXFILTRATION", "POLICY_BYPASS",
)
THREAT_TYPES = THREAT_CATEGORIES + ("RATE_LIMIT_EXCEEDED", "UNAUTHORIZED_ACCESS", "REVOKED_KEY_USAGE")
PII_TYPES = ("EMAIL", "PHONE", "CREDIT_CARD", "SSN")
RISK_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
MODEL_NAMES = {"gpt-4": "GPT-4", "gemini-pro": "Gemini Pro", "claude": "Claude", "llama": "Llama"}
MODEL_ALIASES = {
    "gpt4": "gpt-4", "gpt-4": "gpt-4", "gemini": "gemini-pro", "gemini-pro": "gemini-pro",
    "geminipro": "gemini-pro", "claude": "claude", "llama": "llama",
}

DEFAULT_LIMIT = 100
DEFAULT_WINDOW_S = 60
MAX_PROMPT_CHARS = 8000
MAX_KEY_CHARS = 256
