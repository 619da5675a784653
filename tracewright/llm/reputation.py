"""URL filters by empirical-Bayes host reputation.

Every host gets the posterior of its share of bad pages. The share of bad pages
of a suffix is shrunk towards that of all labelled pages, that of a registered
domain towards its suffix and that of a host towards its domain, each by a
beta-binomial prior whose strength is estimated at that level from all labelled
pages by the method of moments. A host is blocked when the lower bound of its
posterior (the quantile ``1 - level`` of that beta distribution) is over
``limit``, by default the share of bad pages among all labelled ones: the host
is worse than the pages at large, with a probability of ``level``. Whether the
bound is over the limit is read off the distribution function at the limit.
Hosts without labelled pages stand at their domain's posterior. Rules of the
caller come before the reputation: the longest rule whose host is the url's
host or a parent domain of it, and whose path begins the url's path, decides.

Only DataFrame functions; what reaches the driver is a row of three sums.
Counts are made per host and written before anything is joined, so a host with
a third of all pages is one row, and pages meet the verdicts in a join that may
split it.

Nulls and odd rows: a null url, or one without ``://``, has an empty host and
path, no rule, and the reputation of the empty host; a user or port in a host
is no part of its domain and suffix; very long urls are taken whole; several
labels of a page count as one, bad if any is bad; repeated pages each count;
rules are tried from the longest on, and of equally long ones the last wins; a
posterior that touches the limit doesn't block; extra columns are ignored; an
empty table gives an empty result. Without any labels nothing is blocked by
reputation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: Terms of the beta distribution's series; the rest is bounded by a geometric series.
TERMS = 1000
#: Suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za")
#: (verdict, host, path) of each rule of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Letters that a host is folded by.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    plain = host.rlike(r"^[0-9.]*$") | ~host.contains(".")
    two = F.substring_index(host, ".", -2)
    return F.when(plain, host).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and one label more."""
    plain = host.rlike(r"^[0-9.]*$") | ~host.contains(".")
    two = F.substring_index(host, ".", -2)
    return F.when(plain, host).when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (like ``net/``), and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begin)
        rule, verdict = F.when(fits, at + begin).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def intra_class(counts: DataFrame) -> float:
    """Correlation of outcomes within the units of ``n, k, p`` (p: the parent's mean), by moments."""
    between = F.sum(F.pow(F.col("k") - F.col("n") * F.col("p"), 2) - F.col("n") * F.col("p") * (1 - F.col("p")))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * F.col("p") * (1 - F.col("p")))
    row = counts.agg(between.alias("between"), pairs.alias("pairs")).first()
    rho = (row["between"] or 0.0) / row["pairs"] if row["pairs"] else 0.0
    return min(max(round(rho, 9), 0.001), 0.9)


def _shrunk(counts: DataFrame) -> DataFrame:
    """Posterior ``a, b`` of each unit of ``n, k, p``."""
    strength = 1 / intra_class(counts.filter("n > 0")) - 1
    p = F.col("p")
    return counts.withColumns({"a": F.lit(strength) * p + F.col("k"), "b": F.lit(strength) * (1 - p) + F.col("n") - F.col("k")})


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for ``z`` > 0, by Stirling's series at ``z + 8``."""
    w, shift = z + 8, z
    for k in range(1, 8):
        shift = shift * (z + k)
    series = 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w)
    return (w - 0.5) * F.log(w) - w + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(shift)


def beta_below(x: float, a: Column, b: Column) -> Column:
    """Distribution function of beta(a, b) at ``x``, where its mean is over ``x``; null elsewhere.

    By the series with the terms (a+b)(a+b+1).. x^n / (a+1)(a+2)..; they fall
    there. With over ``TERMS`` terms to go, the bound of the rest makes the
    value too great, never too small.
    """

    def step(at: Column, n: Column) -> Column:
        return F.struct((at["term"] * F.lit(x) * (a + b + n) / (a + 1 + n)).alias("term"), (at["total"] + at["term"]).alias("total"))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")), step)
    series = F.element_at(F.transform(F.array(end), lambda e: e["total"] + e["term"] / (1 - F.lit(x) * (a + b + TERMS) / (a + 1 + TERMS))), 1)
    front = a * F.lit(math.log(x)) + b * F.lit(math.log1p(-x)) + log_gamma(a + b) - log_gamma(a + 1) - log_gamma(b)
    # a mean that is the limit but for rounding is not over it
    return F.when(a > F.lit(x) * (a + b) * F.lit(1.000000001), F.least(F.lit(1.0), F.exp(front) * series))


def overall_rate(hosts: DataFrame) -> float:
    """Share of bad pages of all labelled ones (one bad page in twenty before any is labelled)."""
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    return round(((total["k"] or 0) + 1.0) / ((total["n"] or 0) + 20.0), 9)


def reputation(hosts: DataFrame, overall: float) -> DataFrame:
    """Posterior ``a, b`` and its ``mean`` for the share of bad pages of each row of ``host, n, k``."""
    name = name_of(F.col("host"))
    units = hosts.withColumns({"domain": domain_of(name), "suffix": suffix_of(name)})
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("p")
    domains = units.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("p", F.lit(overall))
    suffixes = _shrunk(suffixes).select("suffix", mean)
    domains = _shrunk(domains.join(suffixes, "suffix")).select("domain", "suffix", mean)
    out = _shrunk(units.join(domains, ["domain", "suffix"]))
    return out.select("host", "n", "k", "a", "b", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, level: float = 0.95, limit: float | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the reputation behind it, for every row of ``pages`` (``page_id, url``).

    ``outcomes`` has ``page_id`` and ``bad`` (0 or 1) of the labelled pages.
    ``below`` is the posterior probability that the host's share of bad pages
    is at most ``limit`` (null where the mean is).
    """
    url = F.col("url")
    urls = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    marks = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    hosts = urls.select("page_id", "host").join(marks, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = written(hosts, "hosts")
    overall = overall_rate(hosts)
    below = beta_below(overall if limit is None else limit, F.col("a"), F.col("b"))
    scores = written(reputation(hosts, overall).withColumn("below", F.round(below, 6)), "reputation")
    discard(hosts)
    blocked = F.coalesce(F.col("below") < F.lit(round(1 - level, 9)), F.lit(False))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    return urls.join(scores, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("n").alias("labelled"), F.col("k").alias("bad"), "mean", "below")
