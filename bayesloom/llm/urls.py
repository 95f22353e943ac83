"""URL filters: listed rules, then the reputation of the host by empirical Bayes.

Labelled outcomes of pages (bad or not) are counted by host. A host's rate of bad pages has a beta
prior around its registered domain's rate, that one around its suffix's, and that one around the
rate of all pages; each level's prior strength is estimated from how much its members differ
(moments of the beta-binomial distribution). A host is blocked where the lower bound of its
posterior rate, mean less ``z`` standard deviations, is above ``limit``. Everything is a DataFrame
expression, an aggregate or an equi-join.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged as a host
without outcomes; outcomes of null urls count for the empty host, and a null ``bad`` is no outcome; rows of
null or repeated ids, or repeated urls, are each judged and returned; without any outcome every rate is one
half, with a bound of 0.5 - z * 0.5; empty tables give no rows; further columns of the pages are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Suffixes of two labels under which names are registered; every other suffix is the last label. Pass a longer list where it matters.
TWO_LABELS = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "or.jp", "org.au", "org.uk")

#: Rows of one host or domain are joined in so many parts.
SALTS = 32


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct of ``rule`` and ``verdict``, or null.

    ``rules`` are pairs of a verdict and ``host/path``, a list short enough for a plan. A rule fits its host and
    all subdomains where the path starts with the rule's. Of one rule with both verdicts, block holds.
    """
    found = None
    for rule, verdict in sorted({r: v for v, r in sorted(rules)}.items(), key=lambda x: (-len(x[0]), x[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        it = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, it) if found is None else found.when(fits, it)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def with_domain(hosts: DataFrame, two_labels: Sequence[str] = TWO_LABELS) -> DataFrame:
    """``hosts`` with ``suffix`` and registered ``domain`` of ``host``; addresses of numbers, and empty hosts, stand for themselves."""
    name = F.regexp_replace("host", ":[0-9]*$", "")
    plain = F.substring_index(name, ".", -1)
    suffix = F.when(name.rlike(r"^[0-9.]*$|^\["), name).when(F.substring_index(name, ".", -2).isin(*two_labels), F.substring_index(name, ".", -2)).otherwise(plain)
    found = hosts.withColumn("suffix", suffix)
    return found.withColumn("domain", F.when(name == F.col("suffix"), name).otherwise(F.concat(F.substring_index(F.expr("substring(regexp_replace(host, ':[0-9]*$', ''), 1, length(regexp_replace(host, ':[0-9]*$', '')) - length(suffix) - 1)"), ".", -1), F.lit("."), "suffix")))


def _joined(many: DataFrame, one: DataFrame, key: str, by: Column) -> DataFrame:
    """Left join on ``key``; the rows of one key are dealt over ``SALTS`` parts, to each of which ``one`` sends its row."""
    many = many.withColumn("_salt", F.pmod(by, F.lit(SALTS)).cast("int"))
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.join(one, [key, "_salt"], "left").drop("_salt")


def _strength(groups: DataFrame, least: float = 1e-4) -> float:
    """Prior strength of a level, from columns ``n``, ``k`` and the ``prior`` mean, by moments.

    The groups' squared distance from their priors, beyond what drawing pages explains, over what it would be
    if all pages of a group were alike.
    """
    spread = F.col("prior") * (1 - F.col("prior"))
    over, most = groups.agg(F.sum((F.col("k") - F.col("n") * F.col("prior")) ** 2 - F.col("n") * spread), F.sum(F.col("n") * (F.col("n") - 1) * spread)).first()
    alike = min(max(over / most, least), 1 - least) if most else least
    return 1 / alike - 1


def _posterior_mean(strength: float) -> Column:
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    return (F.lit(strength) * F.col("prior") + k) / (F.lit(strength) + n)


@dataclass
class Reputation:
    """Counts of outcomes by host, posterior means of domains and suffixes, and the strength of the hosts' prior."""

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    mean: float
    strength: float
    two_labels: Sequence[str] = TWO_LABELS


def fit(outcomes: DataFrame, two_labels: Sequence[str] = TWO_LABELS) -> Reputation:
    """Reputation from ``outcomes``: rows of ``url`` and ``bad`` (boolean)."""
    seen = outcomes.where("bad IS NOT NULL").select(host_of(F.col("url")).alias("host"), F.col("bad").cast("long").alias("bad"))
    hosts = cut(with_domain(seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k")), two_labels))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    mean = ((k or 0) + 1) / ((n or 0) + 2)
    suffixes = suffixes.withColumn("prior", F.lit(mean))
    suffixes = cut(suffixes.select("suffix", _posterior_mean(_strength(suffixes)).alias("suffix_mean")))
    domains = _joined(domains, suffixes, "suffix", F.xxhash64("domain")).withColumn("prior", F.col("suffix_mean"))
    domains = cut(domains.select("domain", _posterior_mean(_strength(domains)).alias("domain_mean")))
    strength = _strength(_joined(hosts, domains, "domain", F.xxhash64("host")).withColumn("prior", F.col("domain_mean")))
    return Reputation(hosts.select("host", "n", "k"), domains, suffixes, mean, strength, two_labels)


def host_verdicts(hosts: DataFrame, reputation: Reputation, z: float = 1.645, limit: float = 0.5) -> DataFrame:
    """For each ``host``: ``n_labelled``, ``n_bad``, posterior ``bad_rate``, its lower ``bound``, and ``blocked``."""
    r = reputation
    found = with_domain(hosts.select("host").distinct(), r.two_labels).join(r.hosts, "host", "left")
    found = _joined(_joined(found, r.domains, "domain", F.xxhash64("host")), r.suffixes, "suffix", F.xxhash64("host"))
    found = found.withColumn("prior", F.coalesce("domain_mean", "suffix_mean", F.lit(r.mean)))
    found = found.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("k", F.coalesce("k", F.lit(0))).withColumn("bad_rate", _posterior_mean(r.strength))
    spread = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.lit(r.strength) + F.col("n") + 1))
    found = found.withColumn("bound", F.col("bad_rate") - F.lit(z) * spread)
    return found.select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), "bad_rate", "bound", (F.col("bound") > limit).alias("blocked"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], reputation: Reputation, z: float = 1.645, limit: float = 0.5) -> DataFrame:
    """For each row of ``pages``: page_id, url, host, path, rule, verdict, and what the host's verdict rests on."""
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = _joined(rows, host_verdicts(rows, reputation, z, limit), "host", F.xxhash64("page_id", "url"))
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return rows.select("page_id", "url", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", own).alias("verdict"), "n_labelled", "n_bad", "bad_rate", "bound")
