"""URL filtering by empirical-Bayes host reputation, with DataFrame functions only.

Labelled page outcomes (bad or not) are counted per host. Beta-binomial priors shrink them in a chain: the suffix towards
the whole table, the registered domain towards its suffix, the host towards its domain. The strength of each prior is
estimated by moments from the groups of its own level. A host is blocked when the lower posterior bound of its
share of bad pages is above a limit. Rules (host and path prefix) come before the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup, materialize, maybe_broadcast

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A host is blocked if its share of bad pages is above BAD_SHARE even Z posterior standard deviations below the mean.
BAD_SHARE, Z = 0.5, 1.0
#: Bounds of a prior's strength in pseudo-pages.
STRENGTH = (2.0, 1000.0)
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    """Text after the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _name(host: Column) -> Column:
    return F.regexp_replace(host, ":[0-9]*$", "")


def _is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]+\.){3}[0-9]+$") | name.startswith("[")


def domain_of(host: Column) -> Column:
    """The last two labels of a host without its port; an IP address is its own domain."""
    name = _name(host)
    return F.when(_is_address(name), name).otherwise(F.substring_index(name, ".", -2))


def suffix_of(host: Column) -> Column:
    """The last label of a host without its port; addresses have the suffix `[ip]` in common."""
    name = _name(host)
    return F.when(_is_address(name), "[ip]").otherwise(F.substring_index(name, ".", -1))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(longest fitting rule, its verdict), null where none fits. Rules are few and fixed: a chain of CASE, longest first."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, mean: str) -> float:
    """The pseudo-pages of the beta prior of a level's groups (n, k) around their parents' means, by moments; one number.

    Var(k/n) = m(1-m)(1/n + (1-1/n) * rho) with rho = 1/(strength+1); summed over groups of two pages or more.
    """
    m = F.least(F.greatest(F.col(mean), F.lit(1e-6)), F.lit(1 - 1e-6))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    # n^2 (k/n - m)^2 - n m (1-m) has the mean m (1-m) n (n-1) rho
    over = F.sum((k - n * m) * (k - n * m) - n * m * (1 - m))
    room = F.sum(m * (1 - m) * n * (n - 1))
    rho = F.greatest(F.coalesce(over / room, F.lit(0.0)), F.lit(1e-9))
    return groups.where("n >= 2").agg(F.least(F.greatest(1 / rho - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))).first()[0]


def _shrunk(n: Column, k: Column, strength: float, mean: Column) -> Column:
    return (k + strength * mean) / (n + strength)


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes (host, bad int, null where unlabelled) -> (host, n, k, mean, bound): posterior mean and lower bound of the share of bad pages.

    Outcomes are read once: counts by host combine on the map side, and the higher levels are counts of those counts. Popular domains and suffixes are hot
    keys of a look-up. Unlabelled hosts have their domain's mean as mean. Null hosts count as the empty host; repeated rows count each. An empty table
    gives no rows.
    """
    with Scratch(outcomes.sparkSession, "reputation") as scratch:
        hosts = outcomes.select(F.coalesce("host", F.lit("")).alias("host"), "bad").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
        hosts = scratch.write(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
        domains = scratch.write(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
        suffixes = scratch.write(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
        # the whole table's share, inside (0, 1) by half a page more on each side
        m0 = suffixes.agg((F.coalesce(F.sum("k"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).first()[0]
        s = _strength(suffixes.withColumn("m0", F.lit(m0)), "m0")
        means = suffixes.select("suffix", _shrunk(F.col("n"), F.col("k"), s, F.lit(m0)).alias("m1"))
        domains = scratch.write(lookup(domains, ["suffix"], means), "domains")
        s = _strength(domains, "m1")
        means = domains.select("domain", _shrunk(F.col("n"), F.col("k"), s, F.col("m1")).alias("m2"))
        hosts = scratch.write(lookup(hosts, ["domain"], means), "hosts")
        s = _strength(hosts, "m2")
        a, b = F.col("k") + s * F.col("m2"), F.col("n") - F.col("k") + s * (1 - F.col("m2"))
        mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        return materialize(hosts.select("host", "n", "k", mean.alias("mean"), (mean - Z * sd).alias("bound")), "reputation")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, bad_share: float = BAD_SHARE) -> DataFrame:
    """pages (page_id, url), labels (doc_id of the page, quality, toxic) -> page_id, host, path, rule, verdict, reputation.

    A page is bad if any label row of its id has quality 0 or toxic 1. A null url or one without :// has an empty host and path and is judged as the empty
    host. Repeated rows are judged each; null ids keep their row and are never labelled. Other columns are ignored. Without labels nothing but rules
    blocks. An empty table gives an empty result.
    """
    urls = pages.select("page_id", F.col("url").alias("_url"))
    parts = urls.select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    marked = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    # every row once without a label, so that each host is known, and the labelled ones; null ids never enter the join
    seen = parts.select("host", F.lit(None).cast("int").alias("bad")).union(parts.where("page_id is not null").join(marked, "page_id").select("host", "bad"))
    blocked = materialize(host_reputation(seen).where(F.col("bound") > bad_share).select("host", F.col("mean").alias("reputation")), "blocked")
    size = blocked.agg(F.coalesce(F.sum(F.octet_length("host") + 60), F.lit(0))).first()[0]
    judged = parts.join(maybe_broadcast(blocked, size), "host", "left")  # beyond that size a hot host is split by the skew join
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.when(F.col("reputation").isNotNull(), "block").otherwise("allow")).alias("verdict"), "reputation")
