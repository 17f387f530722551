"""Secret scans: fixed patterns, and assignments whose names say that the literal is a secret."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows_of, text_rows

# The patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 and more; shorter ones would be dropped anyway
MIN_VALUE, MIN_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "literal")

#: How far a part of a name says that its value is secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "private": 0.6, "auth": 0.6, "bearer": 0.8, "key": 0.5, "access": 0.3,
    "signature": 0.4, "salt": 0.4, "cookie": 0.4, "session": 0.3, "client": 0.1,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = frozenset(("changeme", "example", "placeholder", "redacted", "undefined", "required", "password", "string"))
#: A literal is a secret from this score on.
MIN_SCORE = 1.4

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_LITERAL = r'"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\''
# Name, sign and first operand of a statement; possessive, so a text is passed over once.
_STATEMENT = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])(?P<name>{_NAME})["']?[ \t]*+(?::=|=>|[:=](?![:=]))[ \t]*+(?P<rhs>{_LITERAL}|[A-Za-z0-9_+/.=\-]++)""")
_MORE = re.compile(rf"[ \t]*+[+.][ \t]*+(?P<rhs>{_LITERAL}|{_NAME})")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches of each base kind; those too short are dropped after matching."""
    out = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    out += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return out + [Span("hex", *m.span()) for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    """Sum of the weights of a name's parts: `dbPassword`, `db_password` and `db.password` have the same parts."""
    parts = {p.lower() for p in _PARTS.findall(name)}
    if {"api", "key"} <= parts:
        parts = parts - {"key"} | {"apikey"}
    return sum(NAME_WEIGHTS.get(p, 0.0) for p in parts)


def value_score(value: str) -> float:
    """0 to 1: length, alphabet and entropy of a literal; 0 for placeholders, prose and short values."""
    if len(value) < 8 or any(c.isspace() for c in value) or value.lower() in PLACEHOLDERS or value[0] in "$<{%":
        return 0.0
    counts = Counter(value)
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value),
                 any(not c.isalnum() for c in value)))
    if kinds < 2 and bits < 3.0:
        return 0.0
    return min(1.0, bits / 4.0) * (1.0 if kinds > 1 else 0.5)


def assigned_literals(text: str) -> list[Span]:
    """Literals that end up under a sensitive name.

    Statements are lexed in order into name and value; a value is a quoted literal, a bare configuration value,
    a name assigned before, or several of these joined by `+` or `.`. Sensitivity flows back from each name to
    the literals and earlier assignments its value was made of, so `a = "..."; b = a; password = b` scores the
    literal by `password`. One walk from the last assignment to the first does it, in linear time.
    """
    latest: dict[str, int] = {}
    scores: list[float] = []
    made_of: list[list] = []  # spans, and numbers of earlier assignments
    carried, chained = 0.0, -1
    for m in _statements(text):
        name, operands = m
        own = name_score(name.group())
        # In `a = b = "x"` the value belongs to both names.
        scores.append(max(own, carried) if name.start() == chained else own)
        parts = []
        for rhs, start in operands:
            if rhs[0] in "\"'":
                parts.append((start + 1, start + len(rhs) - 1))
            elif rhs in latest:
                parts.append(latest[rhs])
            elif len(rhs) >= 8 and any(c.isdigit() for c in rhs):
                parts.append((start, start + len(rhs)))  # a bare configuration value
        made_of.append(parts)
        latest[name.group()] = len(scores) - 1
        carried, chained = scores[-1], operands[0][1]
    best: dict[tuple, float] = {}
    for i in range(len(scores) - 1, -1, -1):
        for part in made_of[i]:
            if isinstance(part, int):
                scores[part] = max(scores[part], scores[i])
            else:
                best[part] = max(best.get(part, 0.0), scores[i])
    return [Span("literal", *s) for s, w in sorted(best.items()) if w > 0 and w + value_score(text[s[0]:s[1]]) >= MIN_SCORE]


def _statements(text: str):
    """(name match, operands with their places) of each statement, in order."""
    at = 0
    while m := _STATEMENT.search(text, at):
        operands, at = [(m["rhs"], m.start("rhs"))], m.end()
        while more := _MORE.match(text, at):
            operands.append((more["rhs"], more.start("rhs")))
            at = more.end()
        if len(operands) == 1 and m["rhs"][0] not in "\"'":
            at = m.start("rhs")  # a bare value may be the next name
        yield re.compile(_NAME).match(text, m.start("name")), operands


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base, all) spans, each by start, then kind in the order of `KINDS`."""
    def by_place(spans):
        return sorted(set(spans), key=lambda s: (s.start, KINDS.index(s.kind), s.end))

    base = base_spans(text)
    return by_place(base), by_place(base + assigned_literals(text))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with the union of its spans replaced by `mark`, one for each stretch of overlapping spans."""
    out, at, spans = [], 0, all_spans(text)[1]
    i = 0
    while i < len(spans):
        start, end = spans[i].start, spans[i].end
        i += 1
        while i < len(spans) and spans[i].start < end:
            end = max(end, spans[i].end)
            i += 1
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


_SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_assign`, `n_access`, `n_hex`, `base_sha256` and `spans`.

    Offsets count code points, ends are exclusive. `base_sha256` is the digest of `kind:start:end` of the base
    spans by start and kind, joined by commas; `spans` lists all spans the same way. A null or empty text has no
    spans: counts 0, the digest of the empty string, and an empty list. Repeated rows and null ids are scanned
    row by row; an empty table gives an empty result. Whole texts are read, in time linear in their length;
    rows are independent, so nothing is shuffled.
    """
    def run(batches):
        for ids, texts in rows_of(batches, "doc_id", "text"):
            out = []
            for text in texts:
                base, spans = all_spans(text)
                n = Counter(s.kind for s in base)
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((n["assign"], n["access"], n["hex"], digest, joined(spans)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *cols], names=names)

    return text_rows(docs).mapInArrow(run, _SCHEMA)


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every secret in `text` replaced by `mark` and `n_chars`, where there is one, set anew.

    Null texts stay null. All other columns pass through.
    """
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, mark))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out
