"""Host reputation by empirical Bayes, below explicit host and path rules.

Labelled page outcomes are counted per host. A host's share of bad pages is
shrunk to that of its registered domain, the domain's to that of its suffix and
the suffix's to the overall share, each by a beta prior whose strength is
estimated from the spread of the groups at that level (method of moments). A
host is blocked when the lower posterior bound of its share exceeds a limit.

Defined cases: a null address or one without ``://`` has empty host and path,
and the empty host is judged like any other. A page without outcome, or with a
null id, counts for no host but is judged. An id with several outcomes is bad if
one of them is; repeated pages count once each. Without outcomes every host has
the neutral share one half and is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import lower_ascii, only
from freshet.operators.sizing import attach, summarised


@dataclass(frozen=True)
class Rule:
    """``host/path-prefix``; it fits the host, its subdomains, and paths that start so."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")
#: Below this limit of the lower bound a host is allowed.
LIMIT = 0.5
#: Standard deviations below the posterior mean; about a one-sided 95 % bound.
DEVIATIONS = 1.645


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*TWO_LABEL_SUFFIXES), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more; the host itself if it has no more."""
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(last_two)


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct (pattern, verdict); of equally long ones a block."""
    found = F.lit(None).cast("struct<pattern:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "block", r.pattern)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def strength(groups: DataFrame) -> float:
    """Pseudo-observations a group's prior is worth at this level, from (n, bad) rows; one number."""
    total = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"),
        F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"),
        F.count(F.when(F.col("n") > 0, 1)).alias("g"),
        F.coalesce(F.sum(F.expr("if(n > 0, bad * bad / n, 0D)")), F.lit(0.0)).alias("kk"),
        F.coalesce(F.sum((F.col("n") * F.col("n")).cast("double")), F.lit(0.0)).alias("nn"),
    ).first()
    if not 0 < total.k < total.n:
        return 1.0
    m = total.k / total.n
    spread = (total.kk - total.k * m) / (m * (1 - m)) - (total.g - 1)
    room = total.n - total.nn / total.n - (total.g - 1)
    share = round(spread / room, 6) if room > 0 else 0.5
    return 1 / min(max(share, 0.001), 0.999) - 1


def reputation(hosts: DataFrame, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """``hosts`` has one row per host with n and bad; returns it with domain, suffix and blocked."""
    hosts = hosts.select("host", "n", "bad", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    counts = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)
    total = suffixes.agg(*counts).first()
    overall = total.bad / total.n if total.n else 0.5

    def shrunk(level: DataFrame, to: Column) -> Column:
        prior = F.lit(strength(level))
        return (F.col("bad") + prior * to) / (F.col("n") + prior)

    suffix_share = suffixes.select("suffix", shrunk(suffixes, F.lit(overall)).alias("share"))
    domain_share = domains.join(suffix_share, "suffix").select("domain", shrunk(domains, F.col("share")).alias("share"))
    judged = hosts.join(domain_share, "domain")
    prior = F.lit(strength(hosts))
    a = F.col("bad") + prior * F.col("share")
    b = F.col("n") - F.col("bad") + prior * (1 - F.col("share"))
    mean = a / (a + b)
    bound = mean - deviations * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return judged.select("host", "n", "bad", "domain", "suffix", (bound > limit).alias("blocked"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = RULES,
    limit: float = LIMIT,
    deviations: float = DEVIATIONS,
) -> DataFrame:
    """Each page with its host, path, rule and verdict.

    ``pages`` has page_id and url, ``outcomes`` page_id and bad (boolean; null: no
    outcome). Hosts are counted before anything is shuffled by host, and a hot
    host's pages are not brought together to be judged (``sizing.attach``).
    """
    pages = only(pages, "page_id", "url").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    known = only(outcomes, "page_id", "bad").where("page_id IS NOT NULL AND bad IS NOT NULL")
    known = known.groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = (
        pages.select("page_id", "host")
        .join(known, "page_id", "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("bad"))
    )
    hosts = summarised(counted, "hosts").frame
    judged = summarised(reputation(hosts, limit, deviations), "reputation")
    found = fitting(rules, F.col("host"), F.col("path"))
    return (
        attach(pages, judged, ["host"], "left")
        .withColumn("found", found)
        .select(
            "page_id",
            "host",
            "path",
            F.col("found.pattern").alias("rule"),
            F.coalesce(F.col("found.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
            F.col("n").alias("host_outcomes"),
            F.col("bad").alias("host_bad"),
        )
    )


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Labels read as outcomes of the page with the same id: bad if toxic or of low quality."""
    labels = only(labels, "doc_id", "quality", "toxic")
    return labels.select(
        F.col("doc_id").alias("page_id"),
        F.when((F.col("toxic") == 1) | (F.col("quality") == 0), True)
        .when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), False)
        .alias("bad"),
    )
