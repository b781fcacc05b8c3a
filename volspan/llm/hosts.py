"""Empirical-Bayes host reputation of urls, in DataFrame expressions only.

Labelled page outcomes (good or not) are counted per host, registered domain and
suffix. Beta-binomial priors shrink them level by level: a suffix towards all pages, a
domain towards its suffix, a host towards its domain. The strength of each level's
prior comes from the spread between its groups (the intra-class correlation of an
analysis of variance); where groups differ no more than chance makes them, a group weighs as
little as if all labelled pages stood against it. A page is blocked when the upper bound of its host's
posterior share of good pages lies below the share of all labelled pages, that is when the host
is worse than the crawl with the certainty of the bound, or below a given `min_good`. Rules come first: the longest
rule that fits a url decides it.

Defined results: a null url or one without "://" has an empty host and path, fits no
rule, and is judged by the posterior of the empty host; pages without a label count
for no outcome; several labels of a page count as its worst; repeated pages each
count and each get a row; an IP address is its own domain and suffix; without any label the prior is Beta(1, 1) at every level and
nothing is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspan.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which domains are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "ne.jp", "co.nz", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.ar")


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """Without user and port."""
    return F.regexp_extract(host, r"^(?:[^@]*@)?([^:]*)", 1)


def is_address(bare: Column) -> Column:
    """Numbers and dots only: an IP address, which is its own domain and suffix."""
    return bare.rlike(r"^[0-9.]+$")


def suffix_of(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    bare = bare_host(host)
    last, two = F.substring_index(bare, ".", -1), F.substring_index(bare, ".", -2)
    return F.when(is_address(bare), bare).when(two.isin(*two_labels), two).otherwise(last)


def domain_of(host: Column, two_labels: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(is_address(bare), bare).when(two.isin(*two_labels), F.substring_index(bare, ".", -3)).otherwise(two)


def listed_suffixes(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds `domain` and `suffix` to rows of hosts by a list (column `suffix`, of any number of labels): the longest listed ending of
    a host is its suffix, else its last label; one label more is its domain."""
    bare, labels = bare_host(F.col("host")), F.split(bare_host(F.col("host")), r"\.")
    endings = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    known = endings.join(suffixes.select("suffix").distinct(), "suffix").groupBy("host").agg(F.max(F.size(F.split("suffix", r"\."))).alias("listed labels"))
    n = F.coalesce("listed labels", F.lit(1))
    cut = lambda k: F.when(is_address(bare), bare).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), F.size(labels)), "."))
    return hosts.join(known, "host", "left").withColumns({"domain": cut(n + 1), "suffix": cut(n)}).drop("listed labels")


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The struct (rule, action) of the longest rule (host, path start, action) that fits, else null."""
    picked = F.lit(None)
    for rule_host, rule_path, action in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        picked = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(picked)
    return picked


#: A group of one labelled page weighs so much at most against its prior of 1.
LEAST_STRENGTH = 0.01


def prior_strength(groups: DataFrame) -> float:
    """Beta prior strength (a + b) from counts n and good k per group: 1 / rho - 1, and all labelled pages at most."""
    p = F.col("k") / F.col("n")
    r = (
        groups.where("n > 0")
        .agg(F.sum("n").cast("double").alias("n"), F.sum("k").cast("double").alias("k"), F.count("*").alias("g"), F.sum(p * F.col("k")).alias("npp"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"))
        .first()
    )
    if not r.g or r.g < 2 or r.n <= r.g:
        return 2.0
    between = (r.npp - r.k * r.k / r.n) / (r.g - 1)
    within = (r.k - r.npp) / (r.n - r.g)
    size = (r.n - r.nn / r.n) / (r.g - 1)
    rho = (between - within) / (between + (size - 1) * within) if between + (size - 1) * within > 0 else 0.0
    return min(r.n, max(LEAST_STRENGTH, 1.0 / rho - 1.0)) if rho > 0 else r.n


def host_posteriors(counts: DataFrame, suffixes: DataFrame | Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[DataFrame, float]:
    """Posterior `a` and `b` of each host from its row (host, n, k), and the share of good pages of all."""
    if isinstance(suffixes, DataFrame):
        hosts = listed_suffixes(counts, suffixes)
    else:
        hosts = counts.withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    totals = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = totals.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = (total.k + 1.0) / (total.n + 2.0) if total.n else 0.5
    s_host, s_domain, s_suffix = map(prior_strength, (hosts, domains, totals)) if total.n else (2.0, 2.0, 2.0)
    up = lambda s, prior: (F.lit(s) * prior + F.col("k")) / (F.lit(s) + F.col("n"))
    totals = totals.select("suffix", up(s_suffix, F.lit(mean)).alias("suffix_mean"))
    domains = domains.join(totals, "suffix").select("domain", up(s_domain, F.col("suffix_mean")).alias("domain_mean"))
    hosts = hosts.join(domains, "domain")
    posterior = hosts.select("host", (F.lit(s_host) * F.col("domain_mean") + F.col("k")).alias("a"), (F.lit(s_host) * (1 - F.col("domain_mean")) + F.col("n") - F.col("k")).alias("b"))
    return posterior, mean


def upper_bound(a: Column, b: Column, z: float) -> Column:
    """Normal approximation of the upper quantile of Beta(a, b)."""
    mean, n = a / (a + b), a + b
    return mean + F.lit(z) * F.sqrt(mean * (1 - mean) / (n + 1))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    outcome_id: str = "doc_id",
    outcome_col: str = "quality",
    min_good: float | None = None,
    z: float = 1.645,
    suffixes: DataFrame | Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """Per page: `id_col`, `host`, `path`, `rule`, `verdict` and the posterior bound `good_bound`.

    The host counts, one row per host, are written once; all levels are made of them.
    `suffixes` names those of two labels (any other is the last label), or is a whole list of suffixes as a table. Without
    `min_good` a host must be worse than all labelled pages together.
    """
    url = F.col(f"`{url_col}`")
    found = pages.select(F.col(f"`{id_col}`"), url_host(url).alias("host"), url_path(url).alias("path"))
    known = outcomes.where(F.col(f"`{outcome_col}`").isin(0, 1) & F.col(f"`{outcome_id}`").isNotNull()).groupBy(F.col(f"`{outcome_id}`").alias("labelled id")).agg(F.min(outcome_col).cast("long").alias("good"))
    counts = found.join(known, F.col(f"`{id_col}`") == F.col("labelled id"), "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    posterior, mean = host_posteriors(stored(counts, "host_counts"), suffixes)
    posterior = posterior.select("host", upper_bound(F.col("a"), F.col("b"), z).alias("good_bound"))
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    judged = found.join(posterior, "host").withColumn("picked", rule) if rules else found.join(posterior, "host").withColumn("picked", F.lit(None).cast("struct<rule:string,action:string>"))
    own = F.when(F.col("good_bound") < (mean if min_good is None else min_good), "block").otherwise("allow")
    return judged.select(f"`{id_col}`", "host", "path", F.col("picked.rule").alias("rule"), F.coalesce(F.col("picked.action"), own).alias("verdict"), "good_bound")
