"""URL filters: host and path rules, and an empirical-Bayes reputation of the host where no rule fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Host, path and verdict. A rule fits its host and all subdomains where the path starts with the rule's.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Suffixes of two labels under which names are registered; all others have one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za", "co.in", "com.cn")

#: Share of bad pages from which a host is blocked, the one-sided normal quantile of the bound, and the weight of priors.
MAX_BAD, QUANTILE, STRENGTH = 0.5, 1.645, 8.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, with A-Z in small letters; else empty."""
    return F.translate(_after(url, 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return _after(url, 1)


def _after(url: Column, part: int) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return F.coalesce(path if part else host, F.lit(""))


def domains(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a host without a dot is its own suffix and domain."""
    last = F.element_at(F.split(host, r"\."), -1)
    short = F.substring_index(host, ".", -2)
    suffix = F.when(short.isin(*SUFFIXES), short).otherwise(last)
    domain = F.when(short.isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(short)
    return domain, suffix


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (`rule`, `verdict`), or null."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def reputation(hosts: DataFrame, *, strength: float = STRENGTH) -> DataFrame:
    """Posterior (`host`, `mean`, `sd`, pages, bad) of every host of `hosts` (`host`, `domain`, `suffix`, `n`, `bad`).

    Three beta-binomial steps: a suffix is shrunk to the overall rate, a registered domain to its suffix, a host
    to its domain. Each prior weighs as `strength` pages. Levels are sums of the level below, so pages are
    counted once.
    """
    domain = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"))
    suffix = domain.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    every = suffix.agg(F.sum("sn").alias("n"), F.sum("sb").alias("b"))
    # One pseudo page either way: the rate of an empty table is one half.
    rate = (every.select("b").scalar() + 1.0) / (every.select("n").scalar() + 2.0)
    suffix = suffix.select("suffix", ((F.col("sb") + strength * rate) / (F.col("sn") + strength)).alias("s_mean"))
    domain = domain.join(suffix, "suffix").select(
        "domain", "suffix", ((F.col("db") + strength * F.col("s_mean")) / (F.col("dn") + strength)).alias("d_mean"))
    a = F.col("bad") + strength * F.col("d_mean")
    total = F.col("n") + strength
    mean = a / total
    return hosts.join(domain, ["domain", "suffix"]).select(
        "host", "n", "bad", mean.alias("mean"), F.sqrt(mean * (1.0 - mean) / (total + 1.0)).alias("sd"))


def judge(pages: DataFrame, outcomes: DataFrame, *, rules=RULES, max_bad: float = MAX_BAD, quantile: float = QUANTILE,
          strength: float = STRENGTH) -> DataFrame:
    """One row per page: `page_id`, `host`, `path`, `rule`, `verdict`.

    `outcomes` has (`url`, `bad` boolean), the labelled pages; rows with a null label are left out. A rule that
    fits decides; otherwise a host is blocked when the lower posterior bound of its share of bad pages, mean
    minus `quantile` standard deviations, reaches `max_bad`. A null url or one without `://` has an empty host
    and path and is judged as the host of that name; a host without labelled pages is allowed. Repeated rows and
    null ids are judged row by row; an empty table gives an empty result.

    Scale: labelled pages are counted per host in the map tasks, so a host with a third of all pages arrives as one
    row from each; verdicts join back by host, which Spark broadcasts when small and splits where skewed.
    """
    url = F.col("url").cast("string")
    seen = outcomes.where("bad is not null").select(host_of(url).alias("host"), F.col("bad").cast("long").alias("bad"))
    hosts = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = domains(F.col("host"))
    known = reputation(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), strength=strength)
    blocked = known.where(F.col("mean") - quantile * F.col("sd") >= max_bad).select("host", F.lit(True).alias("_bad"))
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_bad"), "block").otherwise("allow"))
    return base.join(blocked, "host", "left").select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def marked_outcomes(pages: DataFrame, min_share: float = 0.02) -> DataFrame:
    """Labelled outcomes from the pages' own text: bad where junk signs `#*$%|` are `min_share` of its characters.

    Pages without text between their tags are not labelled.
    """
    plain = F.regexp_replace(F.col("html").cast("string"), "<[^>]*>", "")
    n = F.length(plain)
    return pages.select("url", F.when(n > 0, F.regexp_count(plain, F.lit("[#*$%|]")) >= min_share * n).alias("bad"))
