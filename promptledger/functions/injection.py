"""Prompt-injection scoring as built-in expressions over a text column."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import RISK_RANK, THREAT_CATEGORIES
from ..session import computed_once
from .rules import DEFAULT_RULES, Detector, Rule
from .text import holds, not_ascii, sql_text, strip_blank

# Characters dropped before matching, and the look-alike fold.
ZERO_WIDTH = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)))
LEET_FROM, LEET_TO = "013457@$", "oieastas"

SCORE_CAP = 5.0
ESCALATE_MEDIUM, ESCALATE_HIGH = 0.6, 1.3


def _nfkc(values: pa.Array) -> pa.Array:
    # pyarrow's own utf8_normalize leaves letters and accents apart under NFKC.
    return pa.array([v if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())


def normalise(c: Column, nfkc: bool = True) -> Column:
    """NFKC, no zero-width characters, runs of blanks other than newline as one space, stripped.

    NFKC is the one step Spark has no built-in for. ASCII text is its own NFKC form and holds nothing to
    drop, so only text with other characters is handed to the Arrow function; for the rest it gets a null.
    """
    if nfkc:
        fold = F.arrow_udf(_nfkc, "string")
        c = F.coalesce(F.translate(fold(F.when(not_ascii(c), c)), ZERO_WIDTH, ""), c)
    else:
        c = F.when(not_ascii(c), F.translate(c, ZERO_WIDTH, "")).otherwise(c)
    # Most texts have only lone spaces, which stay as they are.
    single = F.regexp_replace(c, r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " ")
    return strip_blank(F.when(holds(c, "  ", "\t", "\r", "\f", "\x0b"), single).otherwise(c))


def fold_leet(c: Column) -> Column:
    return F.translate(c, LEET_FROM, LEET_TO)


def _stem_text(c: Column) -> Column:
    # Besides A-Z, four letters equal an ASCII letter when case is ignored; the Kelvin sign lower-cases to k.
    odd = F.translate(c, "".join(map(chr, (0x130, 0x131, 0x17F))), "iis")
    return F.lower(F.when(not_ascii(c), odd).otherwise(c))


# The rule set becomes one SQL text: hundreds of small expressions that the JVM parses in one go.
def _search(rule: Rule, text: str, stems: str) -> str:
    match = f"rlike({text}, {sql_text('(?iU)' + rule.pattern)})"
    groups = ["(" + " or ".join(f"contains({stems}, {sql_text(s)})" for s in g) + ")" for g in rule.stems]
    return "(" + " and ".join(groups + [match] if groups else [f"{text} <> ''", match]) + ")"


def _fired(rules: tuple[Rule, ...]) -> Column:
    """The rules found in `_base` or in its folded variant `_leet`, in order, as (name, weight, code).

    The code is 4 * (3 - rank) + priority of the category, so the smallest is the highest risk and, among
    equals, the first category. Spark evaluates the argument of `filter` as it stands: compiled, so many
    patterns make one method too long for the JVM to optimise.
    """
    entries = []
    for r in rules:
        code = 4 * (3 - RISK_RANK[r.risk_level]) + THREAT_CATEGORIES.index(r.threat_type)
        hit = f"{_search(r, '_base', '_stems')} or _leet <> '' and {_search(r, '_leet', '_leet_stems')}"
        entries.append(f"named_struct('name', {sql_text(r.name)}, 'weight', {float(r.weight)!r}D, 'code', {code}, 'hit', {hit})")
    return F.expr(f"filter(array({', '.join(entries)}), r -> r.hit)")


def _verdict(detector: Detector, out: str) -> Column:
    top = "(3 - _best div 4)"
    lifted = f"if({top} = 1 and _total >= {ESCALATE_MEDIUM}, 2, {top})"
    rank = f"if({lifted} = 2 and _total >= {ESCALATE_HIGH}, 3, {lifted})"
    categories = ", ".join(map(sql_text, THREAT_CATEGORIES))
    return F.expr(f"""named_struct(
        'detected', _best is not null,
        'blocked', coalesce({rank} >= {RISK_RANK[detector.threshold]}, false),
        'threat_type', get(array({categories}), cast(_best % 4 as int)),
        'risk_level', get(array('LOW', 'MEDIUM', 'HIGH'), cast({rank} - 1 as int)),
        'score', least(_total, {SCORE_CAP}D),
        'matched_rules', _fired.name)""").alias(out)


def searchable(df: DataFrame, col: str, keep: list[str], nfkc: bool = True) -> DataFrame:
    """The kept columns with what patterns are run on: the normalised text `_base` and its folded variant `_leet`
    (empty where nothing is folded), and both in lower case, `_stems` and `_leet_stems`."""
    kept = [F.col(f"`{c}`") for c in keep]
    base, leet = F.col("_base"), F.col("_leet")
    step = df.select(*kept, F.coalesce(normalise(F.col(col), nfkc), F.lit("")).alias("_base"))
    # The patterns' blanks cover the ASCII separators as well; Java's do not, so they become another wide blank.
    ascii_separators = "\x1c\x1d\x1e\x1f"
    wide = F.translate(base, ascii_separators, "\u2003" * 4)
    step = step.withColumn("_base", F.when(holds(base, *ascii_separators), wide).otherwise(base))
    step = step.withColumn("_leet", F.when(base.rlike("[013457@$]"), fold_leet(base)).otherwise(F.lit("")))
    return step.withColumns({"_stems": _stem_text(base), "_leet_stems": _stem_text(leet)})


def detect(df: DataFrame, col: str, detector: Detector = Detector(), out: str = "injection",
           nfkc: bool = True) -> DataFrame:
    """Add the detection struct for a text column; blank text is never detected."""
    if not detector.rules:
        return df.withColumn(out, F.expr(
            "named_struct('detected', false, 'blocked', false, 'threat_type', cast(null as string), 'risk_level', "
            "cast(null as string), 'score', 0D, 'matched_rules', cast(array() as array<string>))"))
    keep = [c for c in df.columns if c != out]
    kept = [F.col(f"`{c}`") for c in keep]
    step = searchable(df, col, keep, nfkc)
    step = step.select(*kept, _fired(detector.rules).alias("_fired"))
    step = step.select("*", F.expr("aggregate(_fired.weight, 0D, (total, w) -> total + w)").alias("_total"),
                       F.expr("array_min(_fired.code)").alias("_best"))
    return computed_once(step, keep, _verdict(detector, out))


def blocks_at(injection: Column, threshold: str) -> Column:
    """Whether a detection would be blocked at a threshold; the risk level already holds the final rank."""
    enough = [level for level, rank in RISK_RANK.items() if rank >= RISK_RANK[threshold]]
    return F.coalesce(injection["risk_level"].isin(enough), F.lit(False))


def at_threshold(injection: Column, threshold: str) -> Column:
    """A detection under another threshold, without looking at the text again."""
    return injection.withField("blocked", blocks_at(injection, threshold))


def category_rollup(found: DataFrame, key: str, rules: tuple[Rule, ...] = DEFAULT_RULES, col: str = "injection") -> DataFrame:
    """Per row and category of the rules that fired: highest `rank`, number of `rules` and summed `weight`, 2 places."""
    facts = F.create_map(*[x for r in rules for x in (
        F.lit(r.name), F.struct(F.lit(r.threat_type).alias("category"), F.lit(RISK_RANK[r.risk_level]).alias("rank"),
                                F.lit(float(r.weight)).alias("weight")))])
    fired = found.select(key, F.explode(F.col(col)["matched_rules"]).alias("rule"))
    return fired.select(key, facts[F.col("rule")].alias("f")).groupBy(key, "f.category").agg(
        F.max("f.rank").alias("rank"), F.count("*").alias("rules"), F.round(F.sum("f.weight"), 2).alias("weight"))


def blocked(injection: Column, enabled: Column) -> Column:
    """With the defence off nothing is blocked; the detection itself stays on record."""
    return enabled & injection["blocked"]


def match_rules(prompts: DataFrame, key: str, col: str, rules: tuple[Rule, ...], nfkc: bool = True) -> DataFrame:
    """One row per prompt and matching rule, for rules that come from a table.

    The rule table is configuration: `load_rules` reads and checks it on the driver, and its patterns
    become literals of one projection. Joining prompts to a pattern column would recompile patterns per row.
    """
    found = detect(prompts.select(key, col), col, Detector(rules), "_inj", nfkc)
    return found.select(key, F.explode("_inj.matched_rules").alias("rule"))


def rule_hits(threats: DataFrame, per: str | None = "day") -> DataFrame:
    """How often each rule fired, in total or per `day`, `hour`, ...; expects array `matched_rules`."""
    fired = threats.select("timestamp", F.explode("matched_rules").alias("rule"))
    groups = [F.col("rule")]
    if per:
        groups.insert(0, F.date_trunc(per, F.col("timestamp")).cast("timestamp_ntz").alias("period"))
    return fired.groupBy(*groups).agg(F.count("*").alias("hits"))
