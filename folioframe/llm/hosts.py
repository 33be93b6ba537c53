"""URL filters: host rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are shrunk from host to registered domain to suffix to
the overall rate. The strength of each shrinkage comes from the data: the spread
of the observed rates around the next level's, by the method of moments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import cut

# Rules of the production query: what to do with a host, its subdomains and paths that start so.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Second-level labels that are part of the suffix in front of a two-letter country.
PUBLIC_SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
_COUNTRY = rf"(?:^|\.)((?:{'|'.join(PUBLIC_SECOND)})\.[a-z]{{2}})$"
_ADDRESS = r"^([0-9]+\.){3}[0-9]+$|^\["


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def name_of(host: Column) -> Column:
    """The host without a user in front and a port behind."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def suffix_of(name: Column, suffixes: Sequence[str] = ()) -> Column:
    """The longest of `suffixes` that the name ends with, else the last two labels of a name such as a.co.uk, else the last one; an address is its own."""
    last = F.regexp_extract(name, r"([^.]*)$", 1)
    found = F.when(F.regexp_extract(name, _COUNTRY, 1) != "", F.regexp_extract(name, _COUNTRY, 1)).otherwise(last)
    listed = sorted({s.lower().strip(".") for s in suffixes})
    for labels in sorted({s.count(".") + 1 for s in listed}):
        end = F.substring_index(name, ".", -labels)
        found = F.when(end.isin([s for s in listed if s.count(".") + 1 == labels]), end).otherwise(found)
    return F.when(name.rlike(_ADDRESS), name).otherwise(found)


def domain_of(name: Column, suffix: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    front = F.left(name, F.length(name) - F.length(suffix) - 1)
    return F.when(F.length(name) > F.length(suffix), F.concat(F.substring_index(front, ".", -1), F.lit("."), suffix)).otherwise(name)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, low) of every host in `pages` (host): the lower bound of its posterior share of good pages.

    `outcomes` has host and good (0 or 1, null is no outcome). Counts go up
    from host to domain to suffix to all, each a combining aggregate, so a host
    with a third of the pages costs no more than others; hosts with their counts are
    written once. For a level with groups i
    of n_i outcomes at rate p_i and parents' means m_i, the moments give
    r = (sum n_i (p_i - m_i)^2 / (m_i (1 - m_i)) - K) / (N - K), kept between
    0.001 and 0.999, and a prior worth (1 - r) / r outcomes. The bound is mean less `z`
    standard deviations of the Beta posterior, a normal approximation that is
    rough for hosts with few outcomes and a weak prior. Without outcomes every mean is 0.5.
    """
    both = pages.select("host", F.lit(None).cast("int").alias("good")).union(outcomes.select("host", F.col("good").cast("int")))
    name = name_of(F.col("host"))
    seen = both.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    seen = seen.withColumn("suffix", suffix_of(name, suffixes))
    seen = cut(seen.withColumn("domain", domain_of(name, F.col("suffix"))))
    domains = cut(seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g")))
    ends = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g")))
    # The overall rate, half an outcome added on either side.
    overall = ends.agg((F.coalesce(F.sum("g"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).scalar()

    def shrunk(level: DataFrame) -> DataFrame:
        """`level` has n, g and the parent's mean m; adds the strength and the level's own mean."""
        p, m = F.col("g") / F.col("n"), F.col("m")
        spread = F.sum(F.when(F.col("n") > 0, F.col("n") * (p - m) * (p - m) / (m * (1 - m))))
        groups = F.sum(F.when(F.col("n") > 0, 1.0).otherwise(0.0))
        share = (spread - groups) / (F.sum("n") - groups)
        strength = level.agg(F.coalesce(F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.when(F.sum("n") > groups, share))), F.lit(0.5)).alias("r"))
        k = strength.select((1 - F.col("r")) / F.col("r")).scalar()
        return level.withColumn("k", k).withColumn("mean", (F.col("g") + F.col("k") * m) / (F.col("n") + F.col("k")))

    ends = shrunk(ends.withColumn("m", overall)).select("suffix", F.col("mean").alias("m"))
    domains = shrunk(cut(domains.join(ends, "suffix"))).select("domain", "suffix", F.col("mean").alias("m"))
    hosts = shrunk(cut(seen.join(domains, ["domain", "suffix"])))
    weight = F.col("n") + F.col("k")
    return hosts.select("host", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (weight + 1))).alias("low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, least: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of `pages` (page_id, url).

    The longest fitting rule decides; without one a url is allowed if its host's
    posterior bound reaches `least`, else blocked. `outcomes` has url and good (0
    or 1; null is none), one row for each labelled page; rows that repeat count
    each, and it may be empty. `suffixes` lists public suffixes of any length.

    A null url, or one without `://`, has an empty host and path, no rule, and the
    verdict of the empty host. Rows are kept as they are, repeated ones
    included; other columns are not kept. DataFrame functions only.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    verdicts = {rule: verdict for verdict, rule in rules}
    rule = F.col("rule")
    ruled = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.lit(None).cast("string")
    for name, verdict in verdicts.items():
        by_rule = F.when(rule == name, verdict).otherwise(by_rule)
    hosts = reputation(parsed.select("host"), outcomes.select(host_of(F.col("url")).alias("host"), "good"), z, suffixes)
    by_host = F.when(F.col("low") >= least, "allow").otherwise("block")
    return ruled.join(hosts, "host", "left").select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_host).alias("verdict"))
