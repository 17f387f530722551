"""Audit and compliance analytics over prompt requests, as Spark column functions and DataFrame operators."""

from .functions.injection import detect
from .functions.pii import PiiPattern, contains_pii, scrub, supported_types, with_pattern
from .functions.rules import Detector, Rule
from .operators.quota import admissions, admit, demand, quota_state
from .plans.audit import AuditConfig, AuditResult, audit, decisions, replay
from .session import build_session
from .sources.readers import load_rules, read_keys, read_requests, stream_requests
from .sources.writers import audit_projection, event_json, write_audit

__all__ = [
    "AuditConfig", "AuditResult", "Detector", "PiiPattern", "Rule", "admissions", "admit", "audit", "audit_projection",
    "build_session", "contains_pii", "decisions", "demand", "detect", "event_json", "load_rules", "quota_state",
    "read_keys", "read_requests", "replay", "scrub", "stream_requests", "supported_types", "with_pattern", "write_audit",
]
