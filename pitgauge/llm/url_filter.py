"""URL filter: block and allow rules, and an empirical-Bayes reputation of hosts where no rule fits.

Labelled page outcomes of a host are shrunk through beta-binomial priors: suffix to the whole web, registered domain to suffix, host to
domain. The strength of each level's prior is fitted by moments from how much the groups of that level differ. A host is blocked
if the lower bound of its posterior rate of bad pages is above a limit, so a host with few labels needs a bad domain.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitgauge.llm.common import col, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LIMIT, Z = 0.5, 1.645
STRENGTHS = (0.05, 999.0)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rest_of(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z in lower case; empty for a null or other url."""
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits; of equally long ones the first by name. The rules are a policy list, inlined into the plan."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        row = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, row) if out is None else out.when(fits, row)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def strength(groups: DataFrame) -> float:
    """Prior strength of a level from its groups' ``n``, ``bad`` and parents' mean ``m``.

    A group's squared deviation, in units of binomial variance, is 1 + (n - 1) rho on average; the strength is 1 / rho - 1.
    """
    dev = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m"))))
    r = groups.where("n > 0").agg(dev.alias("s"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
    if not r["n"] or r["n"] == r["k"]:
        return 1.0
    rho = (r["s"] - r["k"]) / (r["n"] - r["k"])
    return STRENGTHS[1] if rho <= 0 else min(STRENGTHS[1], max(STRENGTHS[0], 1 / rho - 1))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n_labelled, mean, bound) from hosts' counts (host, n, bad): posterior mean and lower bound of the rate of bad pages."""
    hosts = outcomes.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"))
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("suffix", suffix_of(F.col("domain")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    level = suffixes.withColumn("m", F.lit(((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)))
    for key, below in (("suffix", domains), ("domain", hosts)):
        s = strength(level)
        mean = ((F.col("bad") + s * F.col("m")) / (F.col("n") + s)).alias("m")
        level = below.join(level.select(key, mean), key)
    s = strength(level)
    a, total_ab = F.col("bad") + s * F.col("m"), F.col("n") + s
    mean = a / total_ab
    return level.select("host", F.col("n").alias("n_labelled"), mean.alias("mean"), (mean - Z * F.sqrt(mean * (1 - mean) / (total_ab + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], limit: float = LIMIT, key: str = "page_id", url: str = "url",
          outcome_key: str = "page_id", bad: str = "bad") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null without), ``verdict`` (the rule's, else the reputation's) and ``n_labelled`` of the host.

    ``outcomes`` has a page id and whether the page is bad (rows with a null there don't count; several labels of a page all
    count). A null url or one without :// has an empty host and path, and the reputation of the empty host. Repeated rows are judged
    each; columns of ``pages`` with the new names are replaced; an empty table gives an empty result.
    """
    kept = without(pages, ["host", "path", "rule", "verdict", "n_labelled"])
    placed = pages.select(*[col(c) for c in kept], host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))
    known = outcomes.where(col(bad).isNotNull()).groupBy(col(outcome_key).alias("_page")).agg(F.count(F.lit(1)).alias("n"), F.sum(col(bad).cast("long")).alias("bad"))
    by_host = placed.select("host", col(key).alias("_page")).join(known, "_page", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known_hosts = reputations(by_host)
    best = best_rule(F.col("host"), F.col("path"), rules)
    judged = placed.join(known_hosts, "host", "left").withColumn("_best", best)
    return judged.select(*[col(c) for c in kept], "host", "path", F.col("_best.rule").alias("rule"),
                         F.coalesce("_best.verdict", F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "n_labelled")
