"""From requests and keys to audit rows and threat events.

Prompts are read once and never shuffled: scrubbing, scoring and the preview happen in the scan stage. What is left,
a narrow row per request with its key looked up, is made unique by request id and checkpointed; budgets, decisions,
audit rows and threat events all start from there.

A request id names one request. Where a log holds it more than once, as at-least-once delivery does, the earliest
row counts (then the smallest transaction id) and the others are the same request again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.injection import at_threshold, blocked as is_blocked, detect
from ..functions.masking import mask_ip
from ..functions.pii import DEFAULT_PATTERNS, PiiPattern, findings, forwarded_text, scrub
from ..functions.rules import Detector
from ..functions.text import count_tokens, preview, to_iso, transaction_id
from ..operators.keys import resolve_keys, touch_keys, with_key_identity
from ..operators.quota import admissions, quota_info
from ..operators.requests import effective_key, model_name, prompt_status, validate
from ..operators.responses import attach_responses
from ..schemas import DEFAULT_LIMIT, DEFAULT_WINDOW_S, MAX_PROMPT_CHARS
from ..session import checkpointed, computed_once


@dataclass(frozen=True)
class AuditConfig:
    """Settings of one run. `secret` keys the hash of API keys; `count` is any tokenizer expression."""

    secret: str = field(repr=False)
    detector: Detector = Detector()
    patterns: Sequence[PiiPattern] = DEFAULT_PATTERNS
    max_prompt_chars: int = MAX_PROMPT_CHARS
    default_limit: int = DEFAULT_LIMIT
    window_s: int = DEFAULT_WINDOW_S
    nfkc: bool = True
    count: object = count_tokens


@dataclass(frozen=True)
class AuditResult:
    """`decided` has one wide row per valid request; the two tables are projections of it.

    `quarantine` holds rejected requests with `errors`; `keys` is the key table with the last use moved on.
    `materialised` says that `decided` is a table already, cut down to what is stored; see `writers.materialised`.
    """

    decided: DataFrame
    transactions: DataFrame
    threats: DataFrame
    quarantine: DataFrame
    keys: DataFrame
    materialised: bool = False


# ---------------------------------------------------------------- steps
# The texts a caller sees, in `threat` and `trace`, are fixed values.
def prepare(valid: DataFrame, config: AuditConfig) -> DataFrame:
    """Identity, token count and masks per request; the raw key ends here."""
    keyed = valid.withColumn("raw_key", effective_key(F.col("api_key"), F.col("header_api_key")))
    return with_key_identity(keyed, config.secret).withColumns({
        "transaction_id": transaction_id(F.col("request_id"), F.col("ts")),
        "input_tokens": config.count(F.col("prompt")),
        "prompt_chars": F.length("prompt"),
        "masked_ip": mask_ip(F.col("client_ip")),
    }).drop("raw_key", "api_key", "header_api_key", "client_ip")


def score(prepared: DataFrame, config: AuditConfig, keep_text: bool = False) -> DataFrame:
    """Scrub and score each prompt, keep the redacted preview and drop the prompt; works on streams too."""
    rows = detect(scrub(prepared, "prompt", config.patterns), "prompt", config.detector, nfkc=config.nfkc)
    rows = rows.withColumn("prompt_preview", preview(F.col("pii.redacted_text")))
    if keep_text:
        rows = rows.withColumn("forwarded_text", forwarded_text(F.col("prompt"), F.col("pii"), F.col("enable_pii")))
    slim = F.struct(*[F.col(f"pii.{f}").alias(f) for f in ("redaction_count", "detected_types", "counts")])
    return rows.withColumn("pii", slim).drop("prompt")


def once(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per request id with its key looked up, materialised: the only pass over what `rows` reads.

    Transaction ids do not compress and follow from id and time, which rows of one id are told apart by first: they are
    neither moved nor kept.
    """
    moved = rows.drop("transaction_id")
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in moved.columns]), F.struct("ts", "masked_key"))
    unique = moved.groupBy(F.col("request_id").alias("_id")).agg(first.alias("_row")).select("_row.*")
    return checkpointed(resolve_keys(unique, keys)).withColumn("transaction_id", transaction_id(F.col("request_id"), F.col("ts")))


def charge(known: DataFrame, config: AuditConfig) -> DataFrame:
    """Quota decisions of the authenticated rows of `once`; the others never touch a budget."""
    return admissions(known.filter(F.col("auth_reason").isNull()), "key_hash", "ts", "request_id", "input_tokens",
                      "key_limit", default_limit=config.default_limit, window_s=config.window_s)


def decide(df: DataFrame) -> DataFrame:
    """Add `blocked`, `status` and `http_status`: authentication, then budget, then policy, then upstream."""
    failed = F.coalesce(F.col("upstream_failed"), F.lit(False)) if "upstream_failed" in df.columns else F.lit(False)
    reason = F.coalesce("auth_reason", F.lit(""))
    over = F.coalesce(~F.col("quota.allowed"), F.lit(False))
    policy = is_blocked(F.col("injection"), F.col("enable_injection"))
    outcomes = (
        (reason.isin("missing", "invalid"), "unauthorized", 401), (reason == "revoked", "forbidden", 403),
        (over, "rate_limited", 429), (policy, "blocked", 403), (failed, "error", 500),
    )
    status, code = F, F
    for cond, name, http in outcomes:
        status, code = status.when(cond, F.lit(name)), code.when(cond, F.lit(http))
    return df.withColumns({"status": status.otherwise("allowed"), "http_status": code.otherwise(200)})


def _event(kind: Column, risk: Column, action: str, rules: Column) -> Column:
    return F.struct(kind.alias("threat_type"), risk.alias("risk_level"), F.lit(action).alias("action"),
                    rules.alias("matched_rules"))


def threat(df: DataFrame) -> DataFrame:
    """Add the struct `threat`, null for requests that give no cause."""
    status, inj = F.col("status"), F.col("injection")
    used = F.concat(F.col("quota.used").cast("string"), F.lit("+"), F.col("input_tokens").cast("string"),
                    F.lit(">"), F.col("quota.limit").cast("string"))
    found = F.when(status == "blocked", _event(inj["threat_type"], inj["risk_level"], "BLOCKED", inj["matched_rules"]))
    event = (
        F.when(status == "unauthorized", _event(F.lit("UNAUTHORIZED_ACCESS"), F.lit("MEDIUM"), "REJECTED",
                                                F.array("auth_reason")))
        .when(status == "forbidden", _event(F.lit("REVOKED_KEY_USAGE"), F.lit("MEDIUM"), "REJECTED",
                                            F.array("auth_reason")))
        .when(status == "rate_limited", _event(F.lit("RATE_LIMIT_EXCEEDED"), F.lit("LOW"), "THROTTLED", F.array(used)))
        .when(status == "blocked", found)
        .when(inj["detected"], _event(inj["threat_type"], inj["risk_level"], "MONITORED", inj["matched_rules"]))
    )
    return df.withColumn("threat", event)


def derive_threats(decided: DataFrame) -> DataFrame:
    """Threat events of decided requests: at most one each."""
    return decided.filter(F.col("threat").isNotNull()).select(
        F.col("request_id").alias("id"), "transaction_id", F.col("ts").alias("timestamp"), "threat.threat_type",
        "threat.risk_level", "threat.action", "masked_ip", F.col("masked_key").alias("masked_api_key"),
        "threat.matched_rules")


def forwarded(decided: DataFrame) -> DataFrame:
    """What goes upstream: (`request_id`, `target_model`, `text`) of the requests nothing stopped.

    For a caller's own batch of model calls; their log, joined by `attach_responses`, completes the audit.
    Needs `forwarded_text`, as `audit(..., keep_text=True)` leaves it.
    """
    return decided.filter(F.col("status").isin("allowed", "error")).select("request_id", "target_model", F.col("forwarded_text").alias("text"))


def build_rows(decided: DataFrame) -> DataFrame:
    """Audit rows. Requests turned away early keep the PII flags but have no redaction and no score."""
    passed = ~F.col("status").isin("unauthorized", "forbidden", "rate_limited")
    answered = F.col("status") == "allowed"
    has_pii = F.col("pii.redaction_count") > 0
    redacted = passed & F.col("enable_pii") & has_pii
    out_tokens = F.when(answered, F.coalesce(F.col("output_tokens"), F.lit(0))).otherwise(0).cast("int")
    latency = F.when(answered, F.coalesce(F.col("llm_latency_ms"), F.lit(0.0))).otherwise(F.lit(0.0))
    return decided.select(
        F.col("request_id").alias("id"), "transaction_id", F.col("ts").alias("timestamp"),
        F.col("key_hash").alias("api_key_hash"), F.col("masked_key").alias("masked_api_key"), "target_model",
        "input_tokens", out_tokens.alias("output_tokens"), (F.col("input_tokens") + out_tokens).alias("total_tokens"),
        F.round(latency, 2).alias("processing_time_ms"), latency.alias("llm_latency_ms"), "status", "http_status",
        has_pii.alias("pii_detected"), redacted.alias("pii_redacted"),
        F.when(redacted, F.col("pii.redaction_count")).otherwise(0).cast("int").alias("redaction_count"),
        F.col("pii.detected_types").alias("pii_types"),
        (passed & F.col("injection.detected")).alias("injection_detected"),
        F.when(passed, F.col("injection.threat_type")).alias("threat_type"),
        F.when(passed, F.col("injection.risk_level")).alias("risk_level"), "masked_ip", "prompt_preview")


def stored(decided: DataFrame) -> DataFrame:
    """The columns that audit rows and threat events are made of: no answers, budgets or matches."""
    def part(name: str, *fields: str) -> Column:
        return F.struct(*[F.col(f"{name}.{f}").alias(f) for f in fields]).alias(name)

    return decided.select(
        "request_id", "transaction_id", "ts", "key_hash", "masked_key", "masked_ip", "target_model", "input_tokens", "output_tokens",
        "llm_latency_ms", "status", "http_status", "enable_pii", part("pii", "redaction_count", "detected_types"),
        part("injection", "detected", "threat_type", "risk_level"), "prompt_preview", "threat")


def trace(decided: DataFrame) -> DataFrame:
    """Per request the stages it went through: array `pipeline` of (stage, status, detail)."""
    status, pii, inj, quota = F.col("status"), F.col("pii"), F.col("injection"), F.col("quota")
    held, model = status == "blocked", F.col("target_model")

    def say(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def stage(name: str, verdict, detail, reached: Column) -> Column:
        verdict = verdict if isinstance(verdict, Column) else F.lit(verdict)
        detail = detail if isinstance(detail, Column) else F.lit(detail)
        return F.when(reached, F.struct(F.lit(name).alias("stage"), verdict.alias("status"), detail.alias("detail")))

    known = ~status.isin("unauthorized", "forbidden")
    charged = known & (status != "rate_limited")
    done = charged & (status != "error")
    has_pii = pii["redaction_count"] > 0
    n = pii["redaction_count"].cast("string")
    types = F.array_join(F.transform(pii["detected_types"],
                                     lambda t: F.concat(t, F.lit("×"), pii["counts"][t].cast("string"))), ", ")
    label = say(inj["threat_type"], " (", inj["risk_level"], ")")
    scored = (
        F.when(~inj["detected"], F.struct(F.lit("passed").alias("s"), F.lit("no injection patterns matched").alias("d")))
        .when(held, F.struct(F.lit("failed").alias("s"), say(label, " via ", F.array_join(inj["matched_rules"], ", ")).alias("d")))
        .when(~F.col("enable_injection"), F.struct(F.lit("flagged").alias("s"), say("defense disabled — monitor only: ", label).alias("d")))
        .otherwise(F.struct(F.lit("flagged").alias("s"), say(label, " below block threshold").alias("d")))
    )
    latency = F.format_string("%.0f", F.coalesce(F.col("llm_latency_ms"), F.lit(0.0)))
    stages = [
        stage("validation", "passed", say(F.col("prompt_chars").cast("string"), " chars, model=", model), F.lit(True)),
        stage("authentication", "passed", say("key ", F.col("masked_key"), " (", F.coalesce("key_name", F.lit("")), ")"), known),
        stage("rate_limit", "passed",
              say(quota["used"].cast("string"), "/", quota["limit"].cast("string"), " tokens used in window"), charged),
        stage("pii_detection", F.when(has_pii, "flagged").otherwise("passed"),
              F.when(has_pii, types).otherwise("no PII found"), charged),
        stage("pii_redaction", F.when(F.col("enable_pii"), "passed").otherwise("skipped"),
              F.when(~F.col("enable_pii"), F.lit("PII scrubbing disabled by caller"))
              .when(has_pii, say(n, " value(s) redacted")).otherwise("nothing to redact"), charged),
        stage("injection_detection", scored["s"], scored["d"], charged),
        stage("policy_decision", F.when(held, "failed").otherwise("passed"),
              F.when(held, "BLOCK — request never forwarded to the LLM").otherwise("ALLOW"), charged),
        stage("llm_forwarding", F.when(held, "skipped").otherwise("passed"),
              F.when(held, F.lit("blocked by policy"))
              .otherwise(say(F.coalesce(model_name(model), model), " responded in ", latency, " ms")), done),
        stage("telemetry", "passed", "audit record stored", done),
    ]
    # Exploding a column makes Spark test it in a filter first, which would build the stages twice more.
    return computed_once(decided, [c for c in decided.columns if c != "pipeline"], F.array_compact(F.array(*stages)).alias("pipeline"))


def response_record(decided: DataFrame) -> DataFrame:
    """The nested result a caller would get for an allowed or blocked request.

    Needs `decided` from `audit(..., keep_text=True)`, which carries the forwarded text.
    """
    traced = trace(decided.filter(F.col("status").isin("allowed", "blocked")))
    held, has_pii = F.col("status") == "blocked", F.col("pii.redaction_count") > 0
    redacted = F.col("enable_pii") & has_pii
    out_tokens = F.when(held, 0).otherwise(F.coalesce(F.col("output_tokens"), F.lit(0)))
    total = F.col("input_tokens") + out_tokens
    latency = F.when(held, F.lit(0.0)).otherwise(F.coalesce(F.col("llm_latency_ms"), F.lit(0.0)))
    return traced.select(
        "transaction_id", to_iso(F.col("ts")).alias("timestamp"), "status",
        F.when(held, "BLOCKED").otherwise("ALLOWED").alias("security_decision"), held.alias("blocked"), "target_model",
        model_name(F.col("target_model")).alias("model_display_name"), F.col("masked_key").alias("masked_api_key"),
        prompt_status(has_pii, F.col("enable_pii"), F.col("pii.redaction_count"), held).alias("original_prompt_status"),
        F.col("forwarded_text").alias("sanitized_prompt"), F.when(~held, F.col("response")).alias("response"),
        has_pii.alias("pii_detected"), redacted.alias("pii_redacted"),
        F.when(redacted, F.col("pii.redaction_count")).otherwise(0).alias("redaction_count"),
        F.col("pii.detected_types").alias("detected_types"), findings(F.col("pii")).alias("pii_findings"),
        F.col("injection.detected").alias("injection_detected"), "injection.threat_type", "injection.risk_level",
        "injection.matched_rules", "input_tokens", out_tokens.alias("output_tokens"), total.alias("total_tokens"),
        F.struct("input_tokens", out_tokens.alias("output_tokens"), total.alias("total_tokens")).alias("token_usage"),
        F.round(latency, 2).alias("processing_time_ms"), latency.alias("llm_latency_ms"),
        quota_info(F.col("quota")).alias("rate_limit"), "pipeline",
        F.when(held, "Request blocked by security policy").alias("error"))


# ---------------------------------------------------------------- whole runs
ANSWER_FIELDS = {"response": "string", "llm_latency_ms": "double", "output_tokens": "int", "upstream_failed": "boolean"}


def _answered(rows: DataFrame, responses: DataFrame | None) -> DataFrame:
    if responses is not None:
        return attach_responses(rows, responses)
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in ANSWER_FIELDS.items()})


def _decided(known: DataFrame, config: AuditConfig, responses: DataFrame | None, settle: bool = False) -> DataFrame:
    quotas = charge(known, config).select("request_id", "quota")
    if settle:
        quotas = checkpointed(quotas)
    return threat(decide(_answered(known.join(quotas, "request_id", "left"), responses)))


def _checked(requests: DataFrame, config: AuditConfig) -> tuple[DataFrame, DataFrame]:
    valid, quarantine = validate(requests, config.max_prompt_chars)
    return prepare(valid, config), quarantine


def decisions(requests: DataFrame, keys: DataFrame, config: AuditConfig, responses: DataFrame | None = None) -> DataFrame:
    """Status and threat of every valid request, without the PII work that does not influence them."""
    prepared, _ = _checked(requests, config)
    found = detect(prepared, "prompt", config.detector, nfkc=config.nfkc).drop("prompt")
    return _decided(once(found, keys), config, responses)


def audit(requests: DataFrame, keys: DataFrame, config: AuditConfig, responses: DataFrame | None = None,
          keep_text: bool = False, settle: bool = False) -> AuditResult:
    """The whole pipeline. With `keep_text` the text that goes upstream stays in `decided`.

    With `settle` the budgets are decided in a job of their own when this is called: what the fold shuffles is gone from
    the disks before the wide rows are joined with its decisions, and these are made once for all tables.

    `responses` is the log of upstream answers; a request whose entry has an error ends as `error`, one
    without an entry counts as not answered yet and is allowed with zero output. Runs one job when called, over
    the requests.
    """
    prepared, quarantine = _checked(requests, config)
    known = once(score(prepared, config, keep_text), keys)
    decided = _decided(known, config, responses, settle)
    valid = known.filter(F.col("auth_reason").isNull())
    return AuditResult(decided, build_rows(decided), derive_threats(decided), quarantine, touch_keys(keys, valid)
                       if "last_used_at" in keys.columns else keys)


def replay(requests: DataFrame, keys: DataFrame, config_a: AuditConfig, config_b: AuditConfig,
           responses: DataFrame | None = None) -> DataFrame:
    """The same requests under two settings: how many moved from which status to which.

    Settings that only differ in threshold, limit or window share one pass over the prompts, and those with equal
    budgets one admission; another rule set is matched in the same pass. Settings that change which requests are
    valid, how keys are hashed or tokens counted are replayed separately.
    """
    same = ("secret", "max_prompt_chars", "nfkc", "count")
    if any(getattr(config_a, f) != getattr(config_b, f) for f in same):
        a, b = (decisions(requests, keys, c, responses) for c in (config_a, config_b))
        both = a.select("request_id", F.col("status").alias("old_status")).join(
            b.select("request_id", F.col("status").alias("new_status")), "request_id")
        return both.groupBy("old_status", "new_status").agg(F.count("*").alias("n"))
    prepared, _ = _checked(requests, config_a)
    found = detect(prepared, "prompt", config_a.detector, "injection", config_a.nfkc)
    if config_a.detector.rules != config_b.detector.rules:
        found = detect(found, "prompt", config_b.detector, "_other", config_b.nfkc)
    else:
        found = found.withColumn("_other", at_threshold(F.col("injection"), config_b.detector.threshold))
    known = once(found.drop("prompt"), keys)
    rows = known.join(charge(known, config_a).select("request_id", F.col("quota")), "request_id", "left")
    if (config_a.default_limit, config_a.window_s) != (config_b.default_limit, config_b.window_s):
        rows = rows.join(charge(known, config_b).select("request_id", F.col("quota").alias("_quota")), "request_id", "left")
    else:
        rows = rows.withColumn("_quota", F.col("quota"))
    old = decide(_answered(rows, responses)).withColumn("old_status", F.col("status"))
    new = decide(old.withColumns({"injection": F.col("_other"), "quota": F.col("_quota")}))
    return new.groupBy("old_status", F.col("status").alias("new_status")).agg(F.count("*").alias("n"))
