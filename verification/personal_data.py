"""PII validators, detectors and reports.

Card, SSN and phone detection need look-around, which the SQL side's RE2 lacks. Over free text those run without
SQL and are compared with a brute-force scan in the tests; over notes built from order columns the SQL knows the
redaction by construction.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from promptledger.functions import pii
from promptledger.functions.text import preview
from promptledger.sources.readers import spread

from .registry import query
from .views import table, texts, view

_CARD_LIKE = "concat(cast(o_orderkey % 9000 + 1000 AS string), lpad(cast(o_custkey * 7919 AS string), 9, '0'), cast(o_orderkey % 10 AS string))"


@query("pii1_luhn", f"""
WITH n AS (SELECT o_orderkey, {_CARD_LIKE} AS c FROM orders),
 d AS (SELECT o_orderkey, c, unnest(range(0, length(c))) AS i FROM n),
 v AS (SELECT o_orderkey, i, cast(reverse(c)[i + 1] AS integer) AS d FROM d)
SELECT o_orderkey, count(*) >= 13 AND sum(CASE WHEN i % 2 = 0 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END) % 10 = 0 AS ok
FROM v GROUP BY o_orderkey""")
def pii1(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", pii.luhn_valid(_CARD_LIKE).alias("ok"))


@query("pii2_digits", r"SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents")
def pii2(spark, sf):
    return texts(spark, sf).select("doc_id", pii.digits("text").alias("digits"))


# Candidates any regex engine finds alike: digit runs with separators, counted per document and verdict.
_LONG_NUMBER = r"[0-9][0-9 -]{11,24}[0-9]"
_SHORT_NUMBER = r"[+(]?[0-9][0-9 ().-]{6,18}[0-9]"


def _candidates(spark, sf, regex, verdict):
    docs = texts(spark, sf)
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(regex), F.lit(0))).alias("c")).select(
        "doc_id", "c", verdict("c").alias("ok"))


@query("pii3_card_validator", rf"""
WITH c AS (SELECT doc_id, row_number() OVER () AS r, c FROM (
   SELECT doc_id, unnest(regexp_extract_all(text, '{_LONG_NUMBER}')) AS c FROM documents)),
 d AS (SELECT r, d, unnest(range(0, length(d))) AS i FROM (SELECT r, regexp_replace(c, '[^0-9]', '', 'g') AS d FROM c)),
 v AS (SELECT r, i, cast(reverse(d)[i + 1] AS integer) AS x FROM d),
 s AS (SELECT r, count(*) AS n, sum(CASE WHEN i % 2 = 0 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END) % 10 = 0 AS luhn FROM v GROUP BY r)
SELECT doc_id, c, n BETWEEN 13 AND 19 AND (luhn
   OR regexp_full_match(c, '[0-9]{{4}}( [0-9]{{4}}){{3}}|[0-9]{{4}}(-[0-9]{{4}}){{3}}')) AS ok
FROM c JOIN s USING (r)""")
def pii3(spark, sf):
    return _candidates(spark, sf, _LONG_NUMBER, pii.valid_credit_card)


_SSN_LIKE = """concat(lpad(cast(o_orderkey * 37 % 1000 AS string), 3, '0'), '-', lpad(cast(o_custkey % 100 AS string), 2, '0'),
 '-', CASE WHEN o_orderkey % 50 = 0 THEN '0000' ELSE lpad(cast(o_orderkey % 10000 AS string), 4, '0') END)"""


@query("pii4_ssn_validator", f"""
SELECT o_orderkey, left(s, 3) NOT IN ('000', '666') AND s[1] <> '9' AND substring(s, 5, 2) <> '00'
   AND right(s, 4) <> '0000' AS ok FROM (SELECT o_orderkey, {_SSN_LIKE} AS s FROM orders)""")
def pii4(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", pii.valid_ssn(_SSN_LIKE).alias("ok"))


@query("pii5_phone_validator", rf"""
SELECT doc_id, c, CASE WHEN starts_with(c, '+') THEN n BETWEEN 8 AND 15
   WHEN regexp_matches(c, '[\s().-]') THEN n BETWEEN 10 AND 15 ELSE n BETWEEN 10 AND 13 END AS ok
FROM (SELECT doc_id, c, length(regexp_replace(c, '[^0-9]', '', 'g')) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_SHORT_NUMBER}')) AS c FROM documents))""")
def pii5(spark, sf):
    return _candidates(spark, sf, _SHORT_NUMBER, pii.valid_phone)


def _detector(spark, sf, name):
    one = [p for p in pii.DEFAULT_PATTERNS if p.pii_type == name]
    return pii.scrub(texts(spark, sf), "text", one).select(
        "doc_id", F.col("pii.redaction_count").alias("n"), F.sha2("pii.redacted_text", 256).alias("text_hash"))


_AT = r"(@|\s*[\[(]\s*at\s*[\])]\s*)"
_DOT = r"(\.|\s*[\[(]\s*dot\s*[\])]\s*)"
_EMAIL = rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+({_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,24}}"


@query("pii6_email", rf"""
SELECT doc_id, cast(len(regexp_extract_all(text, '(?i){_EMAIL}')) AS integer) AS n,
       sha256(regexp_replace(text, '(?i){_EMAIL}', '[REDACTED_EMAIL]', 'g')) AS text_hash FROM documents""")
def pii6(spark, sf):
    return _detector(spark, sf, "EMAIL")


@query("pii7_credit_card")
def pii7(spark, sf):
    return _detector(spark, sf, "CREDIT_CARD")


@query("pii8_ssn")
def pii8(spark, sf):
    return _detector(spark, sf, "SSN")


@query("pii9_phone")
def pii9(spark, sf):
    return _detector(spark, sf, "PHONE")


@query("pii10_redaction")
def pii10(spark, sf):
    phone = pii.DEFAULT_PATTERNS[-1]
    done = pii.redact(texts(spark, sf, "conversations"), "text", phone, "r")
    return done.select("conv_id", "turn", F.col("r.text").alias("redacted_text"), F.col("r.n").alias("n"))


@query("pii11_detector_chain")
def pii11(spark, sf):
    return pii.scrub(texts(spark, sf), "text").select("doc_id", "pii.redacted_text")


@query("pii12_scrub_result")
def pii12(spark, sf):
    counts = F.array_join(F.transform(F.map_entries("pii.counts"),
                                      lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return pii.scrub(view(spark, sf, "requests_v"), "prompt").select(
        "request_id", "pii.redacted_text", "pii.redaction_count",
        F.array_join("pii.detected_types", ",").alias("detected_types"), counts.alias("counts"))


@query("pii13_contains_pii")
def pii13(spark, sf):
    return pii.contains_pii(texts(spark, sf), "text").select("doc_id", "contains_pii")


@query("pii14_scrub_toggle")
def pii14(spark, sf):
    done = pii.scrub(view(spark, sf, "requests_v"), "prompt")
    return done.select("request_id", pii.forwarded_text(F.col("prompt"), F.col("pii"), F.col("enable_pii")).alias("forwarded"),
                       preview(F.col("pii.redacted_text")).alias("prompt_preview"))


@query("pii15_findings")
def pii15(spark, sf):
    done = pii.scrub(texts(spark, sf), "text")
    return done.select("doc_id", F.explode(pii.findings(F.col("pii"))).alias("f")).select("doc_id", "f.type", "f.count")


_MARKED = "concat('text [REDACTED_', replace(pii_types, ',', '] and [REDACTED_'), '] end')"


@query("pii16_placeholders", """
SELECT pii_type, count(*) AS n FROM (SELECT unnest(string_split(pii_types, ',')) AS pii_type FROM transactions_v
   WHERE pii_types <> '') GROUP BY pii_type""")
def pii16(spark, sf):
    return pii.placeholders(view(spark, sf, "transactions_v").select(F.expr(_MARKED).alias("t")), "t")


@query("pii17_leak_check", """
SELECT request_id, prompt AS prompt_preview FROM requests_v WHERE request_id < 0""")
def pii17(spark, sf):
    stored = pii.scrub(view(spark, sf, "requests_v"), "prompt").select(
        "request_id", "api_key", preview(F.col("pii.redacted_text")).alias("prompt_preview"))
    return pii.leak_check(stored, "prompt_preview", raw_key=F.col("api_key")).select("request_id", "prompt_preview")


@query("pii18_presence", rf"""
SELECT source, count(*) AS n_docs, sum(len(regexp_extract_all(text, '{pii.DASHED_SSN}')))::BIGINT AS ssn_like,
   sum(len(regexp_extract_all(text, '{pii.GROUPED_CARD}')))::BIGINT AS card_like,
   sum(len(regexp_extract_all(text, '{pii.PLAIN_EMAIL}')))::BIGINT AS email_like FROM documents GROUP BY source""")
def pii18(spark, sf):
    return pii.pii_presence(texts(spark, sf), "source")


@query("pii19_rate_by_label", rf"""
SELECT quality, toxic, count(*) AS n_docs, count(*) FILTER (regexp_matches(text, '(?i){_EMAIL}')) AS with_email
FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic""")
def pii19(spark, sf):
    email = [p for p in pii.DEFAULT_PATTERNS if p.pii_type == "EMAIL"]
    docs = texts(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return pii.contains_pii(docs, "text", email).groupBy("quality", "toxic").agg(
        F.count("*").alias("n_docs"), F.count_if("contains_pii").alias("with_email"))


# ---------------------------------------------------------------- notes whose redaction is known by construction
_TAKEN = {"EMAIL": ("email", (7, 8, 11)), "CREDIT_CARD": ("card", (0, 2, 8)), "SSN": ("ssn", (3, 8)), "PHONE": ("phone", (5, 8))}


def _expected(*types: str) -> str:
    """SQL text of a note with the values of the given types redacted."""
    text = "text"
    for t in types:
        value, kinds = _TAKEN[t]
        text = f"CASE WHEN kind IN {kinds} THEN replace({text}, {value}, '[REDACTED_{t}]') ELSE {text} END"
    return text


def _count(*types: str) -> str:
    return " + ".join(f"CASE WHEN kind IN {_TAKEN[t][1]} THEN CASE WHEN kind = 11 THEN 2 ELSE 1 END ELSE 0 END" for t in types)


_ALL = tuple(_TAKEN)
_TYPES = "concat_ws(',', " + ", ".join(f"CASE WHEN kind IN {kinds} THEN '{t}' END" for t, (_, kinds) in _TAKEN.items()) + ")"


def _noted(spark, sf, patterns=pii.DEFAULT_PATTERNS):
    return pii.scrub(spread(view(spark, sf, "pii_notes_v")), "text", patterns)


def _add_detector_query(name: str, pii_type: str) -> None:
    @query(name, f"SELECT id, {_expected(pii_type)} AS redacted_text, ({_count(pii_type)})::INTEGER AS n FROM pii_notes_v")
    def detector(spark, sf):
        one = [p for p in pii.DEFAULT_PATTERNS if p.pii_type == pii_type]
        return _noted(spark, sf, one).select("id", "pii.redacted_text", F.col("pii.redaction_count").alias("n"))


_add_detector_query("pii7_card_notes", "CREDIT_CARD")
_add_detector_query("pii8_ssn_notes", "SSN")
_add_detector_query("pii9_phone_notes", "PHONE")


@query("pii10_redaction_notes", f"SELECT id, {_expected('PHONE')} AS redacted_text FROM pii_notes_v")
def pii10_notes(spark, sf):
    done = pii.redact(spread(view(spark, sf, "pii_notes_v")), "text", pii.DEFAULT_PATTERNS[-1], "r")
    return done.select("id", F.col("r.text").alias("redacted_text"))


@query("pii11_chain_notes", f"SELECT id, {_expected(*_ALL)} AS redacted_text FROM pii_notes_v")
def pii11_notes(spark, sf):
    return _noted(spark, sf).select("id", "pii.redacted_text")


@query("pii12_result_notes", f"""
SELECT id, {_expected(*_ALL)} AS redacted_text, ({_count(*_ALL)})::INTEGER AS redaction_count, {_TYPES} AS detected_types,
   CASE WHEN kind = 11 THEN 'EMAIL=2' ELSE replace({_TYPES}, ',', '=1,') || CASE WHEN {_TYPES} <> '' THEN '=1' ELSE '' END END AS counts
FROM pii_notes_v""")
def pii12_notes(spark, sf):
    counts = F.array_join(F.transform(F.map_entries("pii.counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return _noted(spark, sf).select("id", "pii.redacted_text", "pii.redaction_count",
                                    F.array_join("pii.detected_types", ",").alias("detected_types"), counts.alias("counts"))


@query("pii13_contains_notes", f"SELECT id, ({_count(*_ALL)}) > 0 AS contains_pii FROM pii_notes_v")
def pii13_notes(spark, sf):
    return pii.contains_pii(spread(view(spark, sf, "pii_notes_v")), "text").select("id", "contains_pii")


@query("pii14_toggle_notes", f"SELECT id, CASE WHEN id % 2 = 0 THEN {_expected(*_ALL)} ELSE text END AS forwarded, {_expected(*_ALL)} AS prompt_preview FROM pii_notes_v")
def pii14_notes(spark, sf):
    return _noted(spark, sf).select("id", pii.forwarded_text(F.col("text"), F.col("pii"), F.col("id") % 2 == 0).alias("forwarded"),
                                    preview(F.col("pii.redacted_text")).alias("prompt_preview"))


@query("pii15_findings_notes", f"""
SELECT id, type, CASE WHEN kind = 11 THEN 2 ELSE 1 END::INTEGER AS count FROM (
   SELECT id, kind, unnest(string_split({_TYPES}, ',')) AS type FROM pii_notes_v) WHERE type <> ''""")
def pii15_notes(spark, sf):
    found = _noted(spark, sf).select("id", F.explode(pii.findings(F.col("pii"))).alias("f"))
    return found.select("id", "f.type", F.col("f.count").cast("int").alias("count"))


@query("pii17_planted_leaks", f"""
SELECT id, stored FROM (SELECT id, kind, CASE WHEN id % 7 = 0 THEN text WHEN id % 11 = 3 THEN 'kept raw-' || id || ' here' ELSE {_expected(*_ALL)} END AS stored,
   id % 7 = 0 AND ({_count(*_ALL)}) > 0 OR id % 7 <> 0 AND id % 11 = 3 AS leak FROM pii_notes_v) WHERE leak""")
def pii17_planted(spark, sf):
    """Some notes were stored unredacted, some with the raw key of their row."""
    key = F.concat(F.lit("raw-"), F.col("id").cast("string"))
    stored = _noted(spark, sf).select("id", F.when(F.col("id") % 7 == 0, F.col("text")).when(
        F.col("id") % 11 == 3, F.concat(F.lit("kept "), key, F.lit(" here"))).otherwise(F.col("pii.redacted_text")).alias("stored"))
    return pii.leak_check(stored, "stored", raw_key=key).select("id", "stored")


@query("ex1_added_detector", f"SELECT id, replace({_expected(*_ALL)}, 'desk', '[REDACTED_PLACE]') AS redacted_text FROM pii_notes_v")
def ex1_added(spark, sf):
    place = pii.PiiPattern("PLACE", r"\bdesk\b")
    return _noted(spark, sf, pii.with_pattern(pii.DEFAULT_PATTERNS, place, before="SSN")).select("id", "pii.redacted_text")


@query("ex2_supported_types", f"""
SELECT source, pos, type FROM (SELECT DISTINCT source FROM documents),
   (VALUES (0, 'EMAIL'), (1, 'CREDIT_CARD'), (2, 'LOCKER'), (3, 'SSN'), (4, 'PHONE')) t(pos, type)""")
def ex2(spark, sf):
    """The detectors every source is scanned with."""
    chain = pii.with_pattern(pii.DEFAULT_PATTERNS, pii.PiiPattern("LOCKER", "x"), before="SSN")
    types = F.array(*[F.lit(t) for t in pii.supported_types(chain)])
    return table(spark, sf, "documents").select("source").distinct().select("source", F.posexplode(types).alias("pos", "type"))


@query("ex1_custom_detector")
def ex1(spark, sf):
    hex_id = pii.PiiPattern("HEX_ID", r"\b[0-9a-f]{12,}\b", lambda c: c.rlike("[0-9]") & c.rlike("[a-f]"))
    chain = pii.with_pattern(pii.DEFAULT_PATTERNS, hex_id, before="CREDIT_CARD")
    done = pii.scrub(texts(spark, sf), "text", chain)
    return done.select("doc_id", "pii.redaction_count", F.array_join("pii.detected_types", ",").alias("detected_types"))
