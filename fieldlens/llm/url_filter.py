"""URL filters by rules and by empirical-Bayes host reputation, with DataFrame functions only.

A url's host lies after its first ``://`` up to ``/``, ``?``, ``#`` or the end,
A-Z in lower case; its path reaches from there to ``?``, ``#`` or the end. A
rule is a host and the beginning of a path, and fits the host and all its
subdomains; of several the longest decides (of equally long ones the first).

Where no rule fits, the reputation of the host does. Labelled pages are counted
by host. Three beta-binomial levels shrink the share of bad pages: a suffix
(the last label of a host) towards the share of all pages, a registered domain
(the last two labels, or three where the last two are in ``long_suffixes``)
towards its suffix, a host towards its domain. How strongly a level shrinks, the
concentration of its beta prior, is fitted by moments: the spread of the shares
beyond that of binomial draws. A page is blocked when the lower bound of its
host's posterior, mean less ``z`` standard deviations, is above ``threshold``; so a
host with few labelled pages is blocked only if its neighbours are bad too.

Null urls and urls without ``://`` have an empty host and path; pages with an
empty host share one reputation. A host without a dot, or of four numbers, is
its own domain and suffix. Pages without id, or whose id has no label, have no
outcome; ids with several labels count as bad if one of them says so. Repeated
pages count one by one. Without labels nothing is blocked but by rules; an empty
table gives an empty result. Very long urls are read whole. Columns of the pages
other than id and url are not read, so their names can't clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.plans.lineage import materialize

_PARTS = "://([^/?#]*)([^?#]*)"
#: Bounds of a fitted concentration: shares of equal spread as binomial draws give no upper one.
LEAST, MOST = 2.0, 1000.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(text, _PARTS, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting one of (verdict, host/path) rules, or nulls. ``rules`` is a parameter: a short list, tried in order of length."""
    rule = verdict = F
    for answer, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = rule.when(fits, text), verdict.when(fits, answer)
    return (F.lit(None).cast("string"),) * 2 if not rules else (rule, verdict)


def domain_and_suffix(host: Column, long_suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    own = ~host.contains(".") | host.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    two = F.substring_index(host, ".", -2)
    if long_suffixes:
        long = two.isin(*long_suffixes)
        return F.when(own, host).when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(own, host).when(long, two).otherwise(F.substring_index(host, ".", -1))
    return F.when(own, host).otherwise(two), F.when(own, host).otherwise(F.substring_index(host, ".", -1))


def concentration(groups: DataFrame, prior: Column) -> float:
    """Of the beta prior with each group's mean ``prior``, by moments of the shares k/n: between LEAST and MOST, the latter where nothing is spread."""
    spread = F.when(F.col("n") > 0, F.pow(F.col("k") - F.col("n") * prior, 2) / F.col("n") - prior * (1 - prior))
    room = F.when(F.col("n") > 0, prior * (1 - prior) * (F.col("n") - 1))
    sums = groups.agg(F.sum(spread).alias("spread"), F.sum(room).alias("room")).first()
    rho = sums["spread"] / sums["room"] if sums["room"] else 0.0
    return min(max(1 / rho - 1, LEAST), MOST) if rho > 0 else MOST


def reputations(hosts: DataFrame, z: float, long_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``bound`` to (host, n labelled pages, k bad ones), one row a host: the lower bound of the share of bad pages."""
    domain, suffix = domain_and_suffix(F.col("host"), long_suffixes)
    hosts = materialize(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    top = F.lit(((every["k"] or 0) + 1) / ((every["n"] or 0) + 2))

    def shrunk(groups: DataFrame, prior: Column, strength: float, into: str) -> DataFrame:
        return groups.withColumn(into, (F.col("k") + strength * prior) / (F.col("n") + strength))

    means = shrunk(suffixes, top, concentration(suffixes, top), "m").select(F.col("suffix").alias("of"), F.col("m").alias("m_suffix"))
    domains = materialize(domains.join(materialize(means), F.col("suffix") == F.col("of")).drop("of"))
    means = shrunk(domains, F.col("m_suffix"), concentration(domains, F.col("m_suffix")), "m").select(F.col("domain").alias("of"), F.col("m").alias("m_domain"))
    hosts = materialize(hosts.join(materialize(means), F.col("domain") == F.col("of")).drop("of"))
    strength = concentration(hosts, F.col("m_domain"))
    a, b = F.col("k") + strength * F.col("m_domain"), F.col("n") - F.col("k") + strength * (1 - F.col("m_domain"))
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "k", F.greatest(bound, F.lit(0.0)).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], z: float = 1.645, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", long_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The verdict on every page.

    ``outcomes`` has (id, bad): whether the page of that id is bad. Result:
    the id, host, path, rule, verdict (allow or block), and of the host the
    labelled pages, bad ones and the bound.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.groupBy(F.col("id").cast("string").alias("__id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counted = rows.join(known, F.col("page_id").cast("string") == F.col("__id"), "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    # written before the join, so that its inputs are plain exchanges and a hot host can be split
    known = materialize(reputations(counted, z, long_suffixes).withColumnRenamed("host", "__host"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    return rows.join(known, F.col("host") == F.col("__host")).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), F.col("n").alias("host_labelled"), F.col("k").cast("long").alias("host_bad"), F.round("bound", 6).alias("host_bound")
    )
