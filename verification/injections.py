"""Prompt-injection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptledger.functions import injection as inj
from promptledger.functions.rules import DEFAULT_RULES, Detector, Rule
from promptledger.operators.rule_table import match_rule_table
from promptledger.schemas import RISK_RANK

from .registry import query
from .views import table, texts, view

ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]"


def sql_base(expr: str) -> str:
    flat = f"regexp_replace(regexp_replace(nfc_normalize({expr}), '{ZERO_WIDTH}', '', 'g'), '[ \\t\\r\\f\\v]+', ' ', 'g')"
    return rf"regexp_replace({flat}, '^\s+|\s+$', '', 'g')"


def sql_hits(source: str, key: str, text: str, rules=DEFAULT_RULES) -> list[str]:
    """CTEs `variants` and `hits` (key, name, category, rank, weight, pos) for a text column of a relation."""
    pieces = []
    for i, r in enumerate(rules):
        pat = r.pattern.replace("'", "''")
        pieces.append(
            f"SELECT {key}, {i} AS pos, '{r.name}' AS name, '{r.threat_type}' AS category, {RISK_RANK[r.risk_level]} AS rank, "
            f"{r.weight}::DOUBLE AS weight FROM variants WHERE regexp_matches(base, '{pat}', 'i') OR regexp_matches(leet, '{pat}', 'i')")
    return [
        f"variants AS (SELECT {key}, base, translate(base, '013457@$', 'oieastas') AS leet FROM "
        f"(SELECT {key}, {sql_base(text)} AS base FROM {source}))",
        "hits AS (" + "\nUNION ALL ".join(pieces) + ")",
    ]


def sql_verdict(key: str, threshold: int = 2) -> list[str]:
    """CTE `verdict` on top of `hits`; only detected rows."""
    return [
        f"cats AS (SELECT {key}, category, max(rank) AS rank FROM hits GROUP BY {key}, category)",
        f"""best AS (SELECT {key}, category AS threat_type, rank AS top FROM (SELECT *, row_number() OVER (PARTITION BY {key}
   ORDER BY rank DESC, CASE category WHEN 'PROMPT_INJECTION' THEN 0 WHEN 'SYSTEM_PROMPT_EXFILTRATION' THEN 1
   WHEN 'CREDENTIAL_EXFILTRATION' THEN 2 ELSE 3 END) AS r FROM cats) WHERE r = 1)""",
        f"""sums AS (SELECT {key}, list_reduce(list(weight ORDER BY pos), lambda a, b: a + b) AS total,
   string_agg(name, ',' ORDER BY pos) AS matched_rules FROM hits GROUP BY {key})""",
        f"""verdict AS (SELECT {key}, threat_type, least(total, 5.0) AS score, matched_rules,
   CASE risk WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, risk >= {threshold} AS blocked
 FROM (SELECT *, CASE WHEN lifted = 2 AND total >= 1.3 THEN 3 ELSE lifted END AS risk
   FROM (SELECT *, CASE WHEN top = 1 AND total >= 0.6 THEN 2 ELSE top END AS lifted FROM best JOIN sums USING ({key}))))""",
    ]


HITS = sql_hits("requests_v", "request_id", "prompt")
VERDICT = HITS + sql_verdict("request_id")


def _found(spark, sf, detector=Detector()):
    return inj.detect(view(spark, sf, "requests_v"), "prompt", detector)


@query("inj1_normalise", f"SELECT doc_id, {sql_base('text')} AS base FROM documents")
def inj1(spark, sf):
    return texts(spark, sf).select("doc_id", inj.normalise(F.col("text")).alias("base"))


@query("inj2_leet_fold", "SELECT doc_id, translate(text, '013457@$', 'oieastas') AS folded FROM documents")
def inj2(spark, sf):
    return texts(spark, sf).select("doc_id", inj.fold_leet(F.col("text")).alias("folded"))


@query("inj3_rule_match", "SELECT request_id, string_agg(name, ',' ORDER BY pos) AS rules FROM hits GROUP BY request_id", *HITS)
def inj3(spark, sf):
    found = _found(spark, sf).filter("injection.detected")
    return found.select("request_id", F.array_join("injection.matched_rules", ",").alias("rules"))


@query("inj4_builtin_rules", "SELECT name AS rule, count(*) AS n FROM hits GROUP BY name",
       *sql_hits("(SELECT 'd' || doc_id AS k, text AS t FROM documents UNION ALL SELECT 'r' || request_id, prompt FROM requests_v)", "k", "t"))
def inj4(spark, sf):
    docs = texts(spark, sf).select(F.col("text").alias("t"))
    both = docs.unionAll(view(spark, sf, "requests_v").select("prompt"))
    found = inj.detect(both, "t")
    return found.select(F.explode("injection.matched_rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("inj5_category_rollup", """
SELECT request_id, category, max(rank)::INTEGER AS rank, count(*) AS rules, round(sum(weight), 2) AS weight
FROM hits GROUP BY request_id, category""", *HITS)
def inj5(spark, sf):
    return inj.category_rollup(_found(spark, sf), "request_id")


@query("inj6_dominant_category", "SELECT threat_type, count(*) AS n FROM verdict GROUP BY threat_type", *VERDICT)
def inj6(spark, sf):
    found = _found(spark, sf).filter("injection.detected")
    return found.groupBy(F.col("injection.threat_type").alias("threat_type")).agg(F.count("*").alias("n"))


@query("inj7_score", "SELECT request_id, score FROM verdict", *VERDICT)
def inj7(spark, sf):
    return _found(spark, sf).filter("injection.detected").select("request_id", "injection.score")


_WEAK = tuple(Rule(f"weak_{w}", rf"\b{w}\b", "PROMPT_INJECTION", "LOW", 0.35) for w in ("the", "and", "a", "your"))
_STRICT = sql_hits("requests_v", "request_id", "prompt", DEFAULT_RULES + _WEAK)


@query("inj8_escalation", "SELECT request_id, threat_type, risk_level, matched_rules FROM verdict",
       *_STRICT, *sql_verdict("request_id"))
def inj8(spark, sf):
    found = _found(spark, sf, Detector().with_rules(_WEAK)).filter("injection.detected")
    return found.select("request_id", "injection.threat_type", "injection.risk_level",
                        F.array_join("injection.matched_rules", ",").alias("matched_rules"))


@query("inj9_threshold", """
SELECT request_id, coalesce(v.blocked, false) AS at_medium, coalesce(risk_level = 'HIGH', false) AS at_high,
   v.request_id IS NOT NULL AS at_low FROM requests_v LEFT JOIN verdict v USING (request_id)""", *VERDICT)
def inj9(spark, sf):
    found = inj.detect(view(spark, sf, "requests_v").select("request_id", "prompt"), "prompt")
    return found.select("request_id", *[inj.blocks_at(F.col("injection"), level).alias(f"at_{level.lower()}")
                                        for level in ("LOW", "MEDIUM", "HIGH")])


@query("inj10_blank", """
SELECT count(*) AS blank, 0::BIGINT AS detected, 0.0::DOUBLE AS score FROM requests_v WHERE trim(coalesce(prompt, '')) = ''""")
def inj10(spark, sf):
    found = _found(spark, sf).filter(F.trim(F.coalesce("prompt", F.lit(""))) == "")
    return found.agg(F.count("*").alias("blank"), F.count_if("injection.detected").alias("detected"),
                     F.sum("injection.score").alias("score"))


_OWN = (Rule("lighthouse", r"light[- ]?house\s+keeper", "POLICY_BYPASS", "HIGH", 0.9),
        Rule("launch_plan", r"\bplan\s+a\s+\w+\s+launch", "PROMPT_INJECTION"),
        Rule("colour", r"colou?rs?\b", "POLICY_BYPASS", "LOW", 0.2))


@query("inj11_data_driven_rules", "SELECT request_id, matched_rules, risk_level FROM verdict",
       *sql_hits("requests_v", "request_id", "prompt", DEFAULT_RULES + _OWN), *sql_verdict("request_id"))
def inj11(spark, sf):
    found = _found(spark, sf, Detector().with_rules(_OWN)).filter("injection.detected")
    return found.select("request_id", F.array_join("injection.matched_rules", ",").alias("matched_rules"), "injection.risk_level")


@query("ex3_added_rule", "SELECT count(*) AS n FROM hits WHERE name = 'lighthouse'",
       *sql_hits("requests_v", "request_id", "prompt", _OWN))
def ex3(spark, sf):
    found = _found(spark, sf, Detector().with_rule(_OWN[0]))
    return found.agg(F.count_if(F.array_contains("injection.matched_rules", "lighthouse")).alias("n"))


@query("inj12_monitor_only", """
SELECT request_id, enable_injection AND coalesce(v.blocked, false) AS blocked, v.request_id IS NOT NULL AS detected
FROM requests_v LEFT JOIN verdict v USING (request_id)""", *VERDICT)
def inj12(spark, sf):
    return _found(spark, sf).select(
        "request_id", inj.blocked(F.col("injection"), F.col("enable_injection")).alias("blocked"), "injection.detected")


@query("inj13_rule_hits", """
SELECT date_trunc('day', ts)::TIMESTAMP AS period, name AS rule, count(*) AS hits FROM hits JOIN requests_v USING (request_id)
GROUP BY ALL""", *HITS)
def inj13(spark, sf):
    found = _found(spark, sf).select(F.col("ts").alias("timestamp"), "injection.matched_rules")
    return inj.rule_hits(found)


@query("jn8_rule_table", "SELECT request_id, name AS rule FROM hits", *sql_hits("requests_v", "request_id", "prompt", _OWN))
def jn8(spark, sf):
    return inj.match_rules(view(spark, sf, "requests_v"), "request_id", "prompt", _OWN)


#: A rule for each document with two plain words in its third and fourth place: these, one behind the other.
_WORD_RULES = r"""
SELECT concat('doc_', cast(doc_id AS string)) AS name, one, two FROM (
  SELECT doc_id, split_part(text, ' ', 3) AS one, split_part(text, ' ', 4) AS two FROM documents) w
WHERE {match}"""
_PLAIN = {"spark": "one rlike '^[a-z]+$' AND two rlike '^[a-z]+$'", "sql": "regexp_matches(one, '^[a-z]+$') AND regexp_matches(two, '^[a-z]+$')"}


@query("jn8_posted_rules", f"""
SELECT doc_id, r.name AS rule FROM (
  SELECT DISTINCT doc_id, regexp_extract(ps[i], '[\\p{{L}}\\p{{N}}_]+$') AS x, regexp_extract(ps[i + 1], '^[\\p{{L}}\\p{{N}}_]+') AS y
  FROM (SELECT doc_id, ps, unnest(range(1, len(ps))) AS i FROM (
    SELECT doc_id, string_split_regex(lower({sql_base("text")}), '\\s+') AS ps FROM documents) p) q) d
JOIN ({_WORD_RULES.format(match=_PLAIN["sql"])}) r ON x = one AND y = two""")
def jn8_posted(spark, sf):
    """As many rules as documents, a table that is joined with all of them."""
    docs = texts(spark, sf)
    rules = spark.sql("WITH documents AS (SELECT * FROM {documents})" + _WORD_RULES.format(match=_PLAIN["spark"]), documents=docs)
    rules = rules.select("name", F.concat(F.lit(r"\b"), "one", F.lit(r"\s+"), "two", F.lit(r"\b")).alias("pattern"), F.array("one", "two").alias("words"))
    return match_rule_table(docs, "doc_id", "text", rules)
