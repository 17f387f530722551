"""Detection and redaction of personal data with built-in expressions only.

Every detector is a regular expression plus an optional validator. The validator sees the whole match
and a rejected match stays in the text; the scan continues behind it. That rules out folding the check
into a look-ahead, so a detector takes the list of matches, marks each as accepted or not, and puts the
text back together from the pieces between them.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import computed_once
from .text import BLANK, BLANK_CHARS, WORD, placeholder_types, sql_text


@dataclass(frozen=True)
class PiiPattern:
    """A detector.

    `validator` decides on a match: a function from column to column, or SQL text over the match `m`.
    `hint` is SQL text over the column `{t}`, a cheap test that holds for every text with an accepted match.
    """

    pii_type: str
    java_regex: str
    validator: Callable[[Column], Column] | str | None = None
    hint: str | None = None

    @property
    def placeholder(self) -> str:
        return f"[REDACTED_{self.pii_type}]"


# ---------------------------------------------------------------- validators
# SQL text over a match `m`. One text is one call into the JVM, where a Column takes one per operation.
_DECIMALS = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
_TO_ASCII = ", ".join(sql_text("".join(p)) for p in zip(*[(d, str(unicodedata.decimal(d))) for d in _DECIMALS]))
_DIGITS = f"translate(regexp_replace(m, {sql_text(r'\P{Nd}')}, ''), {_TO_ASCII})"
_TRIMMED = f"trim(both {sql_text(BLANK_CHARS)} from m)"


def _let(value: str, body: str) -> str:
    """`body` with `d` standing for `value`, which is computed once."""
    return f"element_at(transform(array({value}), d -> {body}), 1)"


# Rightmost digit first; every second digit is doubled, which maps 0..9 to 0,2,4,6,8,1,3,5,7,9.
_SUM_OK = """aggregate(
    transform(split(reverse(d), ''), (x, i) -> coalesce(
        try_cast(if(i % 2 = 1, translate(x, '0123456789', '0246813579'), x) as int), 0)),
    0, (total, x) -> total + x) % 10 = 0"""
_FOUR_GROUPS = sql_text(r"^\p{Nd}{4}([ -])\p{Nd}{4}\1\p{Nd}{4}\1\p{Nd}{4}$")
LUHN = _let(_DIGITS, f"length(d) >= 13 and {_SUM_OK}")
CARD_CHECK = _let(_DIGITS, f"length(d) between 13 and 19 and (rlike({_TRIMMED}, {_FOUR_GROUPS}) or {_SUM_OK})")
SSN_CHECK = f"rlike({_DIGITS}, '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)[0-9]{{4}}$')"
PHONE_CHECK = _let(f"length({_DIGITS})", f"""case
    when startswith({_TRIMMED}, '+') then d between 8 and 15
    when rlike({_TRIMMED}, {sql_text(r'[\s\x1c-\x1f\x85\p{Z}().-]')}) then d between 10 and 15
    else d between 10 and 13 end""")


def _on(name: str, sql: str) -> Column:
    return F.expr(f"element_at(transform(array({name}), m -> {sql}), 1)")


def digits(name: str) -> Column:
    """Only the decimal digits of a column, as ASCII. Like the checks below it takes a name or SQL text."""
    return _on(name, _DIGITS)


def luhn_valid(name: str) -> Column:
    """Luhn checksum over the digits; false below 13 digits."""
    return _on(name, LUHN)


def valid_credit_card(name: str) -> Column:
    """13 to 19 digits that pass Luhn, or four groups of four with one repeated separator."""
    return _on(name, CARD_CHECK)


def valid_ssn(name: str) -> Column:
    """Nine digits; area not 000, 666 or 9xx, group not 00, serial not 0000."""
    return _on(name, SSN_CHECK)


def valid_phone(name: str) -> Column:
    """8..15 digits with a leading plus, 10..15 with formatting, 10..13 bare."""
    return _on(name, PHONE_CHECK)


# ---------------------------------------------------------------- detectors
_BRACKETED_AT = sql_text(rf"(?iu)[\[(]{BLANK}*at{BLANK}*[\])]")
_EMAIL_HINT = f"contains({{t}}, '@') or (contains({{t}}, '[') or contains({{t}}, '(')) and rlike({{t}}, {_BRACKETED_AT})"
# A phone, card or SSN has at least 8 digits with never more than 2 other characters between them.
# In ASCII text the digits are 0-9, which the regex engine finds much faster than all decimals.
_NUMBER_HINT = f"""if(octet_length({{t}}) > length({{t}}), rlike({{t}}, {sql_text(r'\p{Nd}(?:\P{Nd}{0,2}\p{Nd}){7}')}),
    rlike({{t}}, '[0-9](?:[^0-9]{{0,2}}[0-9]){{7}}'))"""

# The four detector patterns.
_AT = rf"(?:@|{BLANK}*[\[(]{BLANK}*at{BLANK}*[\])]{BLANK}*)"
_DOT = rf"(?:\.|{BLANK}*[\[(]{BLANK}*dot{BLANK}*[\])]{BLANK}*)"
EMAIL_REGEX = (
    rf"(?iu)(?<![\p{{L}}\p{{N}}_.+-])[A-Za-z0-9._%+-]+{_AT}"
    rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,24}}(?![\p{{L}}\p{{N}}_-])"
)
CREDIT_CARD_REGEX = r"(?<![\p{Nd}-])(?:\p{Nd}[ -]?){12,18}\p{Nd}(?![\p{Nd}-])"
SSN_REGEX = (
    r"(?iu)(?<![\p{Nd}-])(?:\p{Nd}{3}([- ])\p{Nd}{2}\1\p{Nd}{4}"
    rf"|(?<=SSN[:#\s\x1c-\x1f\x85\p{{Z}}]){BLANK}*\p{{Nd}}{{9}}"
    rf"|(?<=social security number[:\s\x1c-\x1f\x85\p{{Z}}]){BLANK}*\p{{Nd}}{{9}})(?![\p{{Nd}}-])"
)
_SEP = r"[\s\x1c-\x1f\x85\p{Z}.-]?"
PHONE_REGEX = (
    rf"(?=[+(\p{{Nd}}])(?<![\p{{L}}\p{{N}}_+])(?:\+\p{{Nd}}{{1,3}}{_SEP})?(?:\(\p{{Nd}}{{1,4}}\){_SEP})?"
    rf"\p{{Nd}}{{2,5}}(?:{_SEP}\p{{Nd}}{{2,5}}){{1,4}}(?!{WORD})"
)

DEFAULT_PATTERNS: tuple[PiiPattern, ...] = (
    PiiPattern("EMAIL", EMAIL_REGEX, None, _EMAIL_HINT),
    PiiPattern("CREDIT_CARD", CREDIT_CARD_REGEX, CARD_CHECK, _NUMBER_HINT),
    PiiPattern("SSN", SSN_REGEX, SSN_CHECK, _NUMBER_HINT),
    PiiPattern("PHONE", PHONE_REGEX, PHONE_CHECK, _NUMBER_HINT),
)


def with_pattern(patterns: Sequence[PiiPattern], p: PiiPattern, before: str | None = None) -> tuple[PiiPattern, ...]:
    """The patterns with one more, ahead of type `before`, or last when that type is absent."""
    types = supported_types(patterns)
    at = types.index(before) if before in types else len(types)
    return tuple(patterns[:at]) + (p,) + tuple(patterns[at:])


def supported_types(patterns: Sequence[PiiPattern] = DEFAULT_PATTERNS) -> list[str]:
    return [p.pii_type for p in patterns]


# ---------------------------------------------------------------- redaction
def _judged(name: str, p: PiiPattern) -> Column:
    """The matches in a column, each as (m, ok)."""
    found = f"regexp_extract_all({name}, {sql_text(p.java_regex)}, 0)"
    if p.hint:
        found = f"case when {p.hint.replace('{t}', name)} then {found} end"
    if callable(p.validator):
        return F.transform(F.expr(found), lambda m: F.struct(m.alias("m"), p.validator(m).alias("ok")))
    return F.expr(f"transform({found}, m -> named_struct('m', m, 'ok', {p.validator or 'true'}))")


def _rebuilt(name: str, hits: str, p: PiiPattern) -> Column:
    """The text with accepted matches replaced; blanks at the start of a match are kept."""
    lead = f"left(h.m, length(h.m) - length(ltrim({sql_text(BLANK_CHARS)}, h.m)))"
    return F.expr(f"""case when exists({hits}, h -> h.ok) then array_join(
        zip_with(split({name}, {sql_text(p.java_regex)}, -1), {hits}, (before, h) -> case
            when h is null then before
            when h.ok then concat(before, {lead}, {sql_text(p.placeholder)})
            else concat(before, h.m) end), '')
        else {name} end""")


def _accepted(hits: str) -> str:
    return f"coalesce(size(filter({hits}, h -> h.ok)), 0)"


def redact(df: DataFrame, col: str, p: PiiPattern, out: str = "redacted") -> DataFrame:
    """One detector: add a struct of the new `text` and the number `n` of replacements."""
    keep = [c for c in df.columns if c != out]
    step = df.withColumn("_hits", _judged(f"`{col}`", p))
    result = F.struct(_rebuilt(f"`{col}`", "_hits", p).alias("text"), F.expr(_accepted("_hits")).alias("n"))
    return computed_once(step, keep, result.alias(out))


def scrub(df: DataFrame, col: str, patterns: Sequence[PiiPattern] = DEFAULT_PATTERNS, out: str = "pii") -> DataFrame:
    """Run the detectors in order, each on the text left by the one before, and add the result struct.

    `out` holds `redacted_text`, `redaction_count`, `detected_types` in detector order and `counts`.
    Each step is its own projection, so a list of matches is computed once although it is used twice.
    """
    keep = [c for c in df.columns if c != out]
    kept = [F.col(f"`{c}`") for c in keep]
    step = df.select("*", F.coalesce(F.col(f"`{col}`"), F.lit("")).alias("_text"))
    counts: list[str] = []
    for i, p in enumerate(patterns):
        step = step.select(*kept, *counts, "_text", _judged("_text", p).alias("_hits"))
        step = step.select(*kept, *counts, _rebuilt("_text", "_hits", p).alias("_text"),
                           F.expr(_accepted("_hits")).alias(f"_n{i}"))
        counts.append(f"_n{i}")
    types = ", ".join(f"if({n} > 0, {sql_text(p.pii_type)}, null)" for n, p in zip(counts, patterns))
    numbers = ", ".join(f"nullif({n}, 0)" for n in counts)
    result = F.expr(f"""named_struct('redacted_text', _text, 'redaction_count', {' + '.join(counts)},
        'detected_types', array_compact(array({types})),
        'counts', map_from_arrays(array_compact(array({types})), array_compact(array({numbers}))))""")
    return computed_once(step, keep, result.alias(out))


def contains_pii(df: DataFrame, col: str, patterns: Sequence[PiiPattern] = DEFAULT_PATTERNS,
                 out: str = "contains_pii") -> DataFrame:
    """Add a boolean: does any detector accept a match in the text?"""
    scrubbed = scrub(df, col, patterns, "_pii")
    return scrubbed.withColumn(out, F.col("_pii.redaction_count") > 0).drop("_pii")


def findings(pii: Column) -> Column:
    """The counts as an array of (type, count) in detector order."""
    return F.transform(
        pii["detected_types"], lambda t: F.struct(t.alias("type"), pii["counts"][t].alias("count"))
    )


def forwarded_text(raw: Column, pii: Column, enabled: Column) -> Column:
    """What goes upstream: the redacted text, or the raw one when the caller switched scrubbing off."""
    return F.when(enabled, pii["redacted_text"]).otherwise(raw)


def placeholders(df: DataFrame, col: str) -> DataFrame:
    """Redaction markers by type over already redacted text."""
    return (
        df.select(F.explode(placeholder_types(F.col(col))).alias("pii_type"))
        .groupBy("pii_type").agg(F.count("*").alias("n"))
    )


def leak_check(df: DataFrame, col: str, patterns: Sequence[PiiPattern] = DEFAULT_PATTERNS,
               raw_key: Column | None = None) -> DataFrame:
    """Rows whose stored text still holds PII or, with `raw_key`, that row's raw API key."""
    checked = contains_pii(df, col, patterns, "_leak")
    leaks = F.col("_leak")
    if raw_key is not None:
        leaks = leaks | F.coalesce((F.length(raw_key) > 0) & F.contains(F.col(col), raw_key), F.lit(False))
    return checked.filter(leaks).drop("_leak")


# ---------------------------------------------------------------- RE2-safe subset
# Patterns without look-around, so any SQL engine can count them.
DASHED_SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
GROUPED_CARD = r"\b[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}\b"
PLAIN_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"


def pii_presence(docs: DataFrame, by: str, col: str = "text") -> DataFrame:
    """Per group: documents, and matches of three patterns that are a subset of the detectors."""
    def hits(rx: str) -> Column:
        return F.sum(F.regexp_count(F.col(col), F.lit(rx)))

    return docs.groupBy(by).agg(
        F.count("*").alias("n_docs"), hits(DASHED_SSN).alias("ssn_like"),
        hits(GROUPED_CARD).alias("card_like"), hits(PLAIN_EMAIL).alias("email_like"),
    )
