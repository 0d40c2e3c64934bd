"""URL filter by empirical-Bayes host reputation, with DataFrame functions only.

Labelled page outcomes (good or bad) are counted by host, registered domain
and suffix.  From the suffix down, the rate of each level is shrunk towards
its parent: a beta prior with the parent's mean and `strength` pseudo-pages
plus the level's own counts.  A host is blocked when the lower bound of its
posterior bad rate (mean less z standard deviations) reaches `limit`.
Explicit rules come first; of those that fit a url the longest one decides.

Defined results: a null url or one without "://" has an empty host and path;
hosts that no labelled page names take their domain's posterior, unknown
domains their suffix's, unknown suffixes the global one.  Repeated rows are
repeated in the result, and in the counts where they carry labels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Suffixes of two labels under which names are registered, unless the caller gives a table of them.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za")


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str  # host, then path from its first slash

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def bare_host(host: Column) -> Column:
    """Without user information, port and a dot at the end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


_ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\]?)$"
#: Stands for the suffix of hosts that are addresses; they share nothing closer with each other.
ADDRESS_SUFFIX = "[ip]"


def suffix_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The host's public suffix: one of the two-label ones given, else its last label."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(_ADDRESS), F.lit(ADDRESS_SUFFIX)).when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The name registered under the suffix; an address is a domain of its own."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(_ADDRESS), host).when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):  # the last to fit is the longest
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _shrunk(counts: DataFrame, key: str, parents: DataFrame | None, parent_key: str | None, strength: float) -> DataFrame:
    """Posterior (alpha, beta, mean) of each key from its counts and its parent's mean (or the column prior)."""
    joined = counts
    if parents is not None:
        joined = counts.join(parents.select(parent_key, F.col("mean").alias("prior")), parent_key, "left")
    prior = F.col("prior")
    a, b = F.lit(strength) * prior + F.col("n_bad"), F.lit(strength) * (F.lit(1.0) - prior) + F.col("n_seen") - F.col("n_bad")
    return joined.withColumn("alpha", a).withColumn("beta", b).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def host_reputation(outcomes: DataFrame, strength: float = 8.0, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[dict[str, DataFrame], float]:
    """Posteriors by level from (host, bad) rows: tables `host`, `domain`, `suffix`; and the global rate.

    Pages are summed by host first (partial sums before the one shuffle of
    pages); every further level adds up rows of the level below.
    """
    hosts = outcomes.groupBy("bare").agg(F.count(F.lit(1)).alias("n_seen"), F.sum("bad").alias("n_bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("bare"), suffixes)).withColumn("suffix", suffix_of(F.col("bare"), suffixes))
    both = [F.sum("n_seen").alias("n_seen"), F.sum("n_bad").alias("n_bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*both)
    suffixes = domains.groupBy("suffix").agg(*both)
    seen, bad = suffixes.agg(F.sum("n_seen"), F.sum("n_bad")).first()  # two numbers
    root = ((bad or 0) + 1.0) / ((seen or 0) + 2.0)
    tables = {"suffix": _shrunk(suffixes.withColumn("prior", F.lit(root)), "suffix", None, None, strength)}
    tables["domain"] = _shrunk(domains, "domain", tables["suffix"], "suffix", strength)
    tables["host"] = _shrunk(hosts, "bare", tables["domain"], "domain", strength)
    return tables, root


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], *, page_id: str = "page_id", url: str = "url",
               strength: float = 8.0, z: float = 1.64, limit: float = 0.3, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, plus the posterior mean and lower bound of the host.

    outcomes: rows (url, bad) of the labelled pages, bad being 0 or 1.
    The pages meet the posteriors of their distinct hosts only: those are
    looked up once a host and joined back to the pages, a join that Spark can
    split when one host holds many pages.
    """
    rep, root = host_reputation(outcomes.select(bare_host(url_host(F.col(url))).alias("bare"), F.col("bad").cast("long").alias("bad"))
                          .where(F.col("bad").isNotNull()), strength, suffixes)
    page = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    hosts = page.select("host").distinct().withColumn("bare", bare_host(F.col("host")))
    hosts = hosts.withColumn("domain", domain_of(F.col("bare"), suffixes)).withColumn("suffix", suffix_of(F.col("bare"), suffixes))
    for level, key in (("host", "bare"), ("domain", "domain"), ("suffix", "suffix")):
        hosts = hosts.join(rep[level].select(key, F.struct("alpha", "beta").alias(f"p_{level}")), key, "left")
    anyone = F.struct(F.lit(strength * root).alias("alpha"), F.lit(strength * (1 - root)).alias("beta"))
    hosts = hosts.select("host", F.coalesce("p_host", "p_domain", "p_suffix", anyone).alias("p"))
    a, b = F.col("p.alpha"), F.col("p.beta")
    mean = a / (a + b)
    spread = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1.0)))
    judged = hosts.select("host", F.round(mean, 6).alias("bad_rate"), F.round(mean - F.lit(z) * spread, 6).alias("bad_bound"))
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_bound") >= F.lit(limit), F.lit("block")).otherwise(F.lit("allow"))
    return page.join(judged, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), "bad_rate", "bad_bound")
