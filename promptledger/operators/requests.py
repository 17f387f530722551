"""Request normalisation and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank, strip
from ..schemas import MAX_KEY_CHARS, MAX_PROMPT_CHARS, MODEL_ALIASES, MODEL_NAMES
from ..session import computed_once
from ..sources.readers import CORRUPT, MISTYPED


def _lookup(c: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[c]


def normalise_model(c: Column) -> Column:
    """Canonical model id for friendly spellings; unknown names come back folded but unchanged."""
    folded = F.translate(F.lower(strip(c)), " _", "--")
    return F.coalesce(_lookup(folded, MODEL_ALIASES), folded)


def model_name(c: Column) -> Column:
    """Display name of a canonical model id; null for others."""
    return _lookup(c, MODEL_NAMES)


def effective_key(body: Column, header: Column) -> Column:
    """The key in the request, else the one in the header; empty text counts as absent."""
    return F.coalesce(F.nullif(body, F.lit("")), header)


def client_ip(xff: Column, peer: Column, trust: bool) -> Column:
    """The first forwarded hop when the proxy is trusted and names one, else the peer."""
    if not trust:
        return peer
    first = strip(F.substring_index(xff, ",", 1))
    return F.when(F.coalesce(F.length(xff) > 0, F.lit(False)), first).otherwise(peer)


def check(requests: DataFrame, max_chars: int = MAX_PROMPT_CHARS) -> DataFrame:
    """Stripped and defaulted requests with `errors`, an array of (field, message); empty when valid.

    A malformed record has that one error; a field of a wrong type has no other.
    """
    for name, default in (("header_api_key", F.lit(None).cast("string")), ("client_ip", F.lit(None).cast("string")),
                          ("enable_pii", F.lit(True)), ("enable_injection", F.lit(True))):
        if name not in requests.columns:
            requests = requests.withColumn(name, default)
    clean = requests.withColumns({
        "prompt": strip(F.col("prompt")),
        "api_key": strip(F.col("api_key")),
        "target_model": normalise_model(F.coalesce("target_model", F.lit("gpt-4"))),
        "enable_pii": F.coalesce("enable_pii", F.lit(True)),
        "enable_injection": F.coalesce("enable_injection", F.lit(True)),
    })
    prompt, key = F.col("prompt"), F.col("api_key")
    tests = [
        ("prompt", "field required", prompt.isNull()),
        ("prompt", "must not be blank", prompt.isNotNull() & is_blank(prompt)),
        ("prompt", f"exceeds {max_chars} characters", F.length(prompt) > max_chars),
        ("api_key", f"must have 1 to {MAX_KEY_CHARS} characters", ~F.length(key).between(1, MAX_KEY_CHARS)),
        ("target_model", "unsupported", ~F.col("target_model").isin(*MODEL_NAMES)),
    ]
    if "request_id" in requests.columns:
        tests.append(("request_id", "field required", F.col("request_id").isNull()))
    errors = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, m, bad in tests]))
    if MISTYPED in requests.columns:
        mistyped = F.col(MISTYPED)
        errors = F.concat(mistyped, F.filter(errors, lambda e: ~F.exists(mistyped, lambda m: m["field"] == e["field"])))
    if CORRUPT in requests.columns:
        malformed = F.array(F.struct(F.lit("body").alias("field"), F.lit("malformed record").alias("message")))
        errors = F.when(F.col(CORRUPT).isNotNull(), malformed).otherwise(errors)
    # What is cleaned and found here is filtered on next; it is not to be worked out again in that filter.
    made = ["prompt", "api_key", "target_model"]
    done = computed_once(clean, [c for c in clean.columns if c not in (*made, "errors")], *[F.col(c) for c in made], errors.alias("errors"))
    return done.select(*[F.col(f"`{c}`") for c in clean.columns if c != "errors"], "errors")


def validate(requests: DataFrame, max_chars: int = MAX_PROMPT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and the quarantine with `errors`. Rejected requests are never audited."""
    checked = check(requests, max_chars)
    bad = F.size("errors") > 0
    return checked.filter(~bad).drop("errors", CORRUPT, MISTYPED), checked.filter(bad)


def prompt_status(has_pii: Column, scrub_on: Column, n: Column, blocked: Column) -> Column:
    """What is said about the prompt as it came in; the phrases are fixed values."""
    base = (
        F.when(has_pii & scrub_on, F.concat(F.lit("Contained PII — "), n.cast("string"),
                                            F.lit(" value(s) redacted before forwarding")))
        .when(has_pii, F.lit("Contained PII — scrubbing disabled, forwarded unredacted (audit copy redacted)"))
        .otherwise(F.lit("Clean — no PII detected"))
    )
    return F.concat(base, F.when(blocked, F.lit("; blocked by injection defense")).otherwise(F.lit("")))
