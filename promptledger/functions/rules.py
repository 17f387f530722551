"""Injection rules: the rule record, the built-in rule set and the detector settings."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from ..schemas import RISK_RANK, THREAT_CATEGORIES


@dataclass(frozen=True)
class Rule:
    """A case-insensitive pattern with its category, risk and weight.

    `stems` is a cheap necessary condition: groups of lower-case ASCII pieces, and every text the pattern
    matches holds at least one piece of each group. A text that fails it skips the pattern. Leave it empty
    to always run the pattern.
    """

    name: str
    pattern: str
    threat_type: str
    risk_level: str = "MEDIUM"
    weight: float = 0.8
    stems: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self) -> None:
        if self.threat_type not in THREAT_CATEGORIES:
            raise ValueError(f"unknown threat type {self.threat_type!r}")
        if self.risk_level not in RISK_RANK:
            raise ValueError(f"unknown risk level {self.risk_level!r}")
        re.compile(self.pattern)

    @classmethod
    def from_dict(cls, d: dict) -> "Rule":
        """Build a rule from a record; a missing risk is MEDIUM, a missing weight 0.8."""
        for field in ("name", "pattern", "threat_type"):
            if d.get(field) is None:
                raise KeyError(field)
        weight = d.get("weight")
        return cls(str(d["name"]), str(d["pattern"]), d["threat_type"], d.get("risk_level") or "MEDIUM",
                   0.8 if weight is None else float(weight))


# The built-in rules. Patterns, categories, risks and weights decide what is detected.
_INSTRUCTIONS = r"(?:instructions?|prompts?|rules|directions|directives|guidelines|context|commands?|programming)"
_SECRET = (
    r"(?:api[\s_-]?keys?|passwords?|passwd|credentials?|secrets?|access[\s_-]?tokens?|auth(?:entication)?[\s_-]?tokens?"
    r"|bearer[\s_-]?tokens?|private[\s_-]?keys?|ssh[\s_-]?keys?|env(?:ironment)?[\s_-]?variables|\.env\b|connection[\s_-]?strings?)"
)
_REVEAL = r"(?:reveal|show|print|display|output|repeat|tell|give|leak|dump|expose|list|share|send|return|provide|disclose|read\s+out)"
_NOUN_STEMS = ("instruction", "prompt", "rules", "direct", "guidelines", "context", "command", "programming")
_REVEAL_STEMS = (
    "reveal", "show", "print", "display", "output", "repeat", "tell", "give", "leak", "dump", "expose", "list", "share",
    "send", "return", "provide", "disclose", "read",
)
_SECRET_STEMS = ("key", "passw", "credential", "secret", "token", "variables", ".env", "string")

DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("ignore_previous_instructions",
         rf"\b(?:ignore|forget|skip|drop)\s+(?:all\s+|any\s+)?(?:of\s+)?(?:the\s+|your\s+|my\s+|these\s+|those\s+)?"
         rf"(?:(?:previous|prior|above|earlier|preceding|original|initial|system|existing|current)\s+)+{_INSTRUCTIONS}"
         rf"|\b(?:ignore|forget)\s+(?:all\s+)?(?:of\s+)?(?:your|my)\s+{_INSTRUCTIONS}"
         r"|\bignore\s+(?:all|everything)\s+(?:you\s+(?:were|have\s+been)\s+told|above)",
         "PROMPT_INJECTION", "HIGH", 0.95,
         (("ignore", "forget", "skip", "drop"), _NOUN_STEMS + ("told", "above"))),
    Rule("disregard_instructions",
         rf"\bdisregard\s+(?:all\s+|any\s+)?(?:the\s+|your\s+)?(?:previous\s+|prior\s+|above\s+|earlier\s+|system\s+)?{_INSTRUCTIONS}",
         "PROMPT_INJECTION", "HIGH", 0.9,
         (("disregard",), _NOUN_STEMS)),
    Rule("override_instructions",
         rf"\b(?:override|overwrite|replace)\s+(?:all\s+)?(?:your|the|any|previous|system)\s+(?:system\s+)?{_INSTRUCTIONS}",
         "PROMPT_INJECTION", "HIGH", 0.9,
         (("override", "overwrite", "replace"), _NOUN_STEMS)),
    Rule("forget_everything",
         r"\bforget\s+(?:everything|all)\s+(?:you\s+(?:were|have\s+been)\s+told|above|before)",
         "PROMPT_INJECTION", "HIGH", 0.9,
         (("forget",), ("told", "above", "before"))),
    Rule("new_instructions_marker",
         r"(?:^|\n|\s)(?:new|updated|real|actual)\s+(?:system\s+)?instructions?\s*:",
         "PROMPT_INJECTION", "MEDIUM", 0.7,
         (("instruction",), (":",))),
    Rule("fake_system_role",
         r"(?:^|\n)\s*(?:\[?\s*system\s*\]?|<\s*/?\s*system\s*>|###\s*system)\s*[:>]",
         "PROMPT_INJECTION", "MEDIUM", 0.7,
         (("system",), (":", ">"))),
    Rule("roleplay_persona",
         r"\b(?:pretend|imagine|act\s+as\s+if)\s+(?:that\s+)?you\s+(?:are|were|have)\b",
         "PROMPT_INJECTION", "LOW", 0.35,
         (("pretend", "imagine", "act"), ("you",))),
    Rule("reveal_system_prompt",
         rf"\b{_REVEAL}\s+(?:me\s+|us\s+)?(?:your|the|its)\s+(?:full\s+|entire\s+|complete\s+|exact\s+)?"
         r"(?:system|initial|hidden|original|secret|internal|underlying|developer|base)\s+"
         r"(?:prompt|instructions?|message|rules|configuration|directives|guidelines)",
         "SYSTEM_PROMPT_EXFILTRATION", "HIGH", 0.9,
         (("prompt", "instruction", "message", "rules", "configuration", "directives", "guidelines"),
          ("system", "initial", "hidden", "original", "secret", "internal", "underlying", "developer", "base"))),
    Rule("what_is_system_prompt",
         r"\bwhat\s+(?:is|are|was|were)\s+your\s+(?:system\s+|initial\s+|hidden\s+|original\s+)(?:prompt|instructions?|rules)",
         "SYSTEM_PROMPT_EXFILTRATION", "HIGH", 0.85,
         (("what",), ("your",), ("prompt", "instruction", "rules"))),
    Rule("repeat_text_above",
         r"\b(?:repeat|print|output|echo)\s+(?:everything|all|the\s+text|the\s+words|verbatim)\s+(?:above|before|preceding|prior)",
         "SYSTEM_PROMPT_EXFILTRATION", "MEDIUM", 0.7,
         (("repeat", "print", "output", "echo"), ("above", "before", "preceding", "prior"))),
    Rule("system_prompt_mention",
         r"\b(?:system\s+prompt|system\s+instructions)\b",
         "SYSTEM_PROMPT_EXFILTRATION", "LOW", 0.3,
         (("system",), ("prompt", "instructions"))),
    Rule("reveal_credentials",
         rf"\b{_REVEAL}\s+(?:me\s+|us\s+)?(?:the\s+|your\s+|all\s+|any\s+|every\s+)?(?:\w+\s+){{0,2}}?"
         rf"(?:admin|root|master|secret|private|internal|production|prod|system|database|db|aws|stored)?\s*{_SECRET}",
         "CREDENTIAL_EXFILTRATION", "HIGH", 0.9,
         (_SECRET_STEMS, _REVEAL_STEMS)),
    Rule("what_is_credential",
         rf"\bwhat\s+(?:is|are)\s+(?:the|your)\s+(?:admin\s+|root\s+|master\s+|secret\s+|internal\s+)?{_SECRET}",
         "CREDENTIAL_EXFILTRATION", "HIGH", 0.85,
         (("what",), _SECRET_STEMS)),
    Rule("cat_secret_files",
         r"\b(?:cat|type|open|read)\s+(?:/etc/passwd|/etc/shadow|~?/?\.ssh/|\.env\b|id_rsa)",
         "CREDENTIAL_EXFILTRATION", "HIGH", 0.9,
         (("/etc/", ".ssh/", ".env", "id_rsa"),)),
    Rule("bypass_restrictions",
         r"\b(?:bypass|circumvent|evade|get\s+around|work\s+around|break\s+out\s+of)\s+(?:all\s+|any\s+)?(?:of\s+)?"
         r"(?:your|the|these|its)?\s*(?:security|safety|content|ethical|moderation)?\s*"
         r"(?:restrictions|filters?|guardrails|rules|policies|safeguards|limitations|protections|controls)",
         "POLICY_BYPASS", "HIGH", 0.9,
         (("bypass", "circumvent", "evade", "around", "break"),
          ("restrictions", "filter", "guardrails", "rules", "policies", "safeguards", "limitations", "protections", "controls"))),
    Rule("now_unrestricted",
         r"\byou\s+are\s+(?:now\s+)?(?:an?\s+)?(?:unrestricted|unfiltered|uncensored|jailbroken|unbound|"
         r"free\s+from\s+(?:all\s+)?(?:rules|restrictions|guidelines))",
         "POLICY_BYPASS", "HIGH", 0.95,
         (("you",), ("unrestricted", "unfiltered", "uncensored", "jailbroken", "unbound", "free"))),
    Rule("disregard_safety",
         r"\b(?:disregard|ignore|abandon|forget)\s+(?:all\s+|any\s+|your\s+)?(?:safety|security|ethical|content)\s+"
         r"(?:rules|guidelines|policies|protocols|restrictions|measures|filters)",
         "POLICY_BYPASS", "HIGH", 0.95,
         (("disregard", "ignore", "abandon", "forget"), ("safety", "security", "ethical", "content"))),
    Rule("disable_safety",
         r"\b(?:disable|turn\s+off|deactivate|switch\s+off|remove)\s+(?:all\s+|your\s+|the\s+)?"
         r"(?:safety|content|security|moderation)\s+(?:filters?|guardrails|features|mode|checks|protocols)",
         "POLICY_BYPASS", "HIGH", 0.9,
         (("disable", "turn", "deactivate", "switch", "remove"), ("safety", "content", "security", "moderation"))),
    Rule("jailbreak_keywords",
         r"\b(?:jailbreak|jail-break|dan\s+mode|do\s+anything\s+now|developer\s+mode\s+(?:enabled|on)|god\s+mode)\b",
         "POLICY_BYPASS", "HIGH", 0.9,
         (("jail", "mode", "anything"),)),
    Rule("no_restrictions",
         r"\bwithout\s+(?:any\s+)?(?:restrictions|limitations|filters|censorship|guardrails|moral\s+constraints)",
         "POLICY_BYPASS", "MEDIUM", 0.6,
         (("without",), ("restrictions", "limitations", "filters", "censorship", "guardrails", "constraints"))),
)


@dataclass(frozen=True)
class Detector:
    """A rule set and the lowest risk level that blocks."""

    rules: tuple[Rule, ...] = DEFAULT_RULES
    threshold: str = "MEDIUM"

    def __post_init__(self) -> None:
        if self.threshold not in RISK_RANK:
            raise ValueError(f"unknown risk level {self.threshold!r}")
        object.__setattr__(self, "rules", tuple(self.rules))

    def with_rule(self, rule: Rule) -> "Detector":
        return self.with_rules([rule])

    def with_rules(self, rules: Sequence[Rule]) -> "Detector":
        return replace(self, rules=self.rules + tuple(rules))
