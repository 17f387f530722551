"""Text, time and quota-level column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The characters with the Unicode White_Space property, and the same set plus the four
# ASCII separators U+001C..U+001F that Python's str.strip/str.split also treat as blank.
WHITE_SPACE = "".join(map(chr, (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
BLANK_CHARS = WHITE_SPACE + "\x1c\x1d\x1e\x1f"

#: The same blanks, and word characters, as Java regex classes.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

#: ceil(len / 6) tokens per word and one per punctuation mark, in a single scan.
_TOKEN = r"[\p{L}\p{N}_]{1,6}|[^\p{L}\p{N}_\s\p{Z}\x85\x1c-\x1f]"

PREVIEW_CHARS = 240

# Keyword groups, first hit wins.
TOPIC_KEYWORDS = (
    ("security", ("security", "threat", "vulnerab", "attack", "breach", "zero trust")),
    ("compliance", ("complian", "gdpr", "hipaa", "soc 2", "soc2", "pci", "regulat", "audit")),
    ("engineering", ("code", "python", "function", "api", "sql", "javascript", "bug", "debug")),
    ("reporting", ("summar", "report", "quarter", "q1", "q2", "q3", "q4", "revenue", "sales")),
    ("customer", ("customer", "email", "support", "ticket", "refund", "account", "order")),
    ("data", ("data", "machine learning", "ml", "model", "ai", "llm", "analytics")),
)
# Words that never open a topic phrase.
STOP_WORDS = (
    "the a an and or to of for in on is are me my please can you how what why do i we our with about give "
    "tell write explain at it this that be should could would from by as your some list"
).split()
PLACEHOLDER = r"\[REDACTED_[A-Z_]+\]"


def sql_text(s: str) -> str:
    """A string literal for SQL text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def not_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def holds(c: Column, *pieces: str) -> Column:
    return reduce(Column.__or__, [c.contains(p) for p in pieces])


def strip(c: Column) -> Column:
    """Drop White_Space characters from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_blank(c: Column) -> Column:
    """Like `strip`, also dropping the ASCII separators U+001C..U+001F."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def is_blank(c: Column) -> Column:
    """True for null, empty and all-blank text."""
    return F.coalesce(strip_blank(c) == "", F.lit(True))


def count_tokens(c: Column) -> Column:
    """Approximate token count; 0 for null and empty text."""
    return F.coalesce(F.regexp_count(c, F.lit(_TOKEN)), F.lit(0)).cast("int")


def to_iso(c: Column) -> Column:
    """ISO-8601 text with truncated milliseconds and a `Z` suffix; expects UTC timestamps."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def transaction_id(*key_cols: Column) -> Column:
    """Repeatable transaction id: the same request gets the same id on every run."""
    parts = [c.cast("string") for c in key_cols]
    return F.concat(F.lit("txn_"), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(24)))


def preview(c: Column, n: int = PREVIEW_CHARS) -> Column:
    """Blanks collapsed, at most `n` characters, an ellipsis when cut."""
    text = F.coalesce(c, F.lit(""))
    # Most texts are ASCII with only lone spaces, which stay as they are.
    odd = not_ascii(text) | holds(text, "  ", *[b for b in BLANK_CHARS if b < "\x80" and b != " "])
    flat = strip_blank(F.when(odd, F.regexp_replace(text, BLANK + "+", " ")).otherwise(text))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.left(flat, F.lit(n - 1)), F.lit("…")))


def topic_tag(c: Column) -> Column:
    """Name of the first keyword group found in the lower-cased text, else `generic`."""
    low = F.lower(c)
    tag = F
    for name, words in TOPIC_KEYWORDS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        tag = tag.when(hit, F.lit(name))
    return tag.otherwise(F.lit("generic"))


def topic_phrase(c: Column, n: int = 4) -> Column:
    """The first `n` words that are not stop words, lower-cased; placeholders do not count."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), PLACEHOLDER, " ")
    words = F.transform(
        F.regexp_extract_all(clean, F.lit(r"[A-Za-z][A-Za-z0-9'-]*"), F.lit(0)), lambda w: F.lower(w)
    )
    stop = F.split(F.lit(" ".join(STOP_WORDS)), " ")
    kept = F.slice(F.filter(words, lambda w: ~F.array_contains(stop, w)), 1, n)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(F.lit("your request"))


def hash_bucket(c: Column, n: int) -> Column:
    """SHA-256 of the text, read as one big number, modulo `n`."""
    if not 1 <= n < 2**31:
        raise ValueError("n must be in 1..2^31-1")
    digest = F.sha2(c, 256)
    shift = 2**32 % n
    acc = F.lit(0).cast("long")
    for i in range(8):
        part = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        acc = (acc * F.lit(shift).cast("long") + part) % F.lit(n).cast("long")
    return acc.cast("int")


def placeholder_types(c: Column) -> Column:
    """Types named by the redaction markers in the text, in order of appearance."""
    return F.regexp_extract_all(c, F.lit(r"\[REDACTED_([A-Z_]+)\]"), F.lit(1))


def quota_level(used: Column, limit: Column) -> Column:
    """`ok` below 60 % of the limit, `warn` from 60 %, `crit` from 90 %."""
    pct = quota_percent(used, limit)
    return F.when(pct >= 90, "crit").when(pct >= 60, "warn").otherwise("ok")


def quota_percent(used: Column, limit: Column) -> Column:
    """Share of the limit in use, capped at 100; 0 without a limit."""
    return F.when(F.coalesce(limit, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), used * F.lit(100.0) / limit)
    )


def nearest_rank(column: str, pct: float) -> Column:
    """Aggregate over a named column: the nearest-rank percentile to 2 places, 0.0 for an empty group.

    The value is rounded before it is ranked. Rounding keeps the order, so the answer is unchanged, and
    the aggregation buffer holds one entry per distinct hundredth instead of one per row.
    """
    return F.expr(
        f"coalesce(percentile_disc({pct / 100.0}) WITHIN GROUP (ORDER BY round(`{column}`, 2)), 0.0D)"
    )


def bucket_minutes(window_minutes: int) -> int:
    """Bucket width of a chart window; other windows are rejected."""
    widths = {15: 1, 60: 1, 360: 5, 1440: 30}
    if window_minutes not in widths:
        raise ValueError("window_minutes must be one of 15, 60, 360, 1440")
    return widths[window_minutes]
