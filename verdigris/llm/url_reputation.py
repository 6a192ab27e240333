"""URL filter by empirical-Bayes host reputation (DataFrame operations only).

Labelled page outcomes (1: bad) are counted by host. A host's rate of bad pages is shrunk to that of its
registered domain, the domain's to that of its public suffix and the suffix's to the rate of all pages, each
by a beta-binomial prior whose strength is fitted to the level by moments. A host is blocked when the lower
bound of its posterior rate is over a threshold: a few bad pages on a new host under a clean domain don't
block it, many do. Rules by host and path come before the reputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint

#: Fixed values: (action, host, path). A rule fits its host and all subdomains if the path starts with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Suffixes of more than one label under which names are registered; any other suffix is the last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in")
#: The quantile of the normal distribution for the posterior's lower bound, and the rate of bad pages that it must pass.
Z, BAD_RATE = 1.645, 0.2
#: Bounds of a prior's strength, in pages: even where rates vary a lot, a host needs some pages of its own.
WEAKEST, STRONGEST = 4.0, 1000.0
#: A page is labelled bad when its html holds at least so many runs of junk marks.
JUNK, JUNK_RUNS = r"(?:###|%%%|\$\$\$|\*\*\*|&amp;&amp;&amp;|&&&)", 10


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or without ://: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(action, rule); null if none does."""
    out = None
    for action, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        value = F.struct(F.lit(action).alias("action"), F.lit(name + start).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<action:string,rule:string>")


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The public suffix of a host."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1)) if long_suffixes else F.substring_index(host, ".", -1)


def domain_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(two) if long_suffixes else two


def public_suffixes(lines: DataFrame) -> DataFrame:
    """(rule, kind) of a public suffix list, one line a row in the list's usual format: comments (//), `*.` and `!` rules.

    kind: 0 a suffix, 1 any one label before it, 2 an exception, a registered name of its own.
    """
    line = F.lower(F.regexp_extract(F.col(lines.columns[0]), r"^\s*(\S*)", 1))
    rules = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("//"))
    kind = F.when(F.col("line").startswith("!"), 2).when(F.col("line").startswith("*."), 1).otherwise(0)
    return rules.select(F.regexp_replace("line", r"^(!|\*\.)", "").alias("rule"), kind.alias("kind")).distinct()


def registered(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host, ...) with domain and suffix by a public suffix list (public_suffixes).

    The longest rule that a host's end matches holds, an exception before all; no match: the last label. Only
    distinct ends of hosts meet the list, whose size Spark checks before it broadcasts it.
    """
    labels = F.split("host", r"\.")
    ends = hosts.select("host").distinct().select("host", F.size(labels).alias("labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("n"))
    ends = ends.withColumn("rule", F.expr("substring_index(host, '.', -n)"))
    size = F.when(F.col("kind") == 2, F.col("n") - 1).when(F.col("kind") == 1, F.least(F.col("n") + 1, F.col("labels"))).otherwise(F.col("n"))
    found = ends.join(suffixes, "rule").groupBy("host").agg(F.max(F.struct((F.col("kind") == 2).alias("exception"), size.alias("size"))).alias("best"))
    n = F.coalesce(F.col("best.size"), F.lit(1))
    tail = lambda k: F.concat_ws(".", F.slice(F.split("host", r"\."), F.greatest(F.size(F.split("host", r"\.")) - k + 1, F.lit(1)), k))
    return hosts.join(found, "host", "left").withColumns({"suffix": tail(n), "domain": tail(n + 1)}).drop("best")


def page_outcome(html: Column, junk_runs: int = JUNK_RUNS) -> Column:
    """The label of a page: 1 if its html is full of junk marks, else 0; null html: no label."""
    return F.when(html.isNull(), F.lit(None)).otherwise((F.regexp_count(html, F.lit(JUNK)) >= junk_runs).cast("long"))


def _level(counts: DataFrame, key: str, prior: Column) -> DataFrame:
    """counts (key, n, bad, and what `prior` reads) with the level's prior strength and each key's posterior mean.

    Strength by moments: the variance of rates beyond what counts of this size have by chance gives the
    beta's a + b, between WEAKEST and STRONGEST; none left gives STRONGEST, which follows the level above.
    """
    rate = F.col("bad") / F.col("n")
    one = counts.withColumn("__vg_prior", prior)
    chance = F.col("__vg_prior") * (1 - F.col("__vg_prior"))
    moments = one.agg(
        F.sum(F.col("n") * (rate - F.col("__vg_prior")) * (rate - F.col("__vg_prior"))).alias("seen"),
        F.sum(chance).alias("by_chance"),
        F.sum(F.col("n") * chance).alias("weighted"),
    )
    over = F.col("seen") - F.col("by_chance")
    between = over / F.col("weighted")  # the beta's variance as a share of p(1 - p): 1 / (a + b + 1)
    strength = moments.select(F.when((F.col("weighted") > 0) & (over > 0), F.greatest(F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / between - 1))).otherwise(F.lit(STRONGEST)))
    k = F.col(f"{key}_k")
    return one.withColumn(f"{key}_k", strength.scalar()).withColumn(f"{key}_mean", (F.col("bad") + k * F.col("__vg_prior")) / (F.col("n") + k)).drop("__vg_prior")


def host_reputation(labelled: DataFrame, z: float = Z, suffixes: DataFrame | None = None) -> DataFrame:
    """A row for each host of labelled (host, outcome): n, bad, its posterior mean and the lower bound.

    Null outcomes don't count. Counts are summed on each side of the shuffle first, so a hot host is one
    row a task. They are written once, a row a host, and all levels are made of them; each level's strength is
    a scalar subquery. suffixes: a table of public_suffixes; without one LONG_SUFFIXES hold.
    """
    hosts = labelled.where(F.col("outcome").isNotNull()).groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("outcome").cast("double").alias("bad"))
    hosts = registered(hosts, suffixes) if suffixes is not None else hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    hosts = checkpoint(hosts)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    levels = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Two pages, one bad, keep the rate of all pages away from 0 and 1.
    every = levels.agg((F.sum("bad") + 1) / (F.sum("n") + 2))
    levels = _level(levels.withColumn("__vg_all", every.scalar()), "suffix", F.col("__vg_all")).select("suffix", "suffix_mean")
    domains = checkpoint(_level(domains.join(levels, "suffix"), "domain", F.col("suffix_mean")).select("domain", "domain_mean"))
    hosts = _level(hosts.join(domains, "domain"), "host", F.col("domain_mean"))
    mean, k = F.col("host_mean"), F.col("n") + F.col("host_k")
    return hosts.select("host", "n", "bad", "host_mean", (mean - z * F.sqrt(mean * (1 - mean) / (k + 1))).alias("bound"))


def filter_urls(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, z: float = Z, bad_rate: float = BAD_RATE, suffixes: DataFrame | None = None) -> DataFrame:
    """A row for each page: id_col, host, path, rule, verdict, judged_by (`rule`, `host` or `prior`).

    labelled has host and outcome. The verdict is the rule's; else block where the posterior's lower bound
    is over bad_rate, else allow: also for hosts without labels and urls without a host (null or no ://,
    host and path empty). Repeated rows stay; other columns aren't read.
    """
    urls = pages.select(F.col(f"`{id_col}`").alias("__vg_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    urls = urls.withColumn("__vg_rule", rule_of(F.col("host"), F.col("path"), rules))
    known = host_reputation(labelled, z, suffixes).select("host", (F.col("bound") > bad_rate).alias("__vg_bad"))
    out = urls.join(known, "host", "left")
    return out.select(
        F.col("__vg_id").alias(id_col),
        "host",
        "path",
        F.col("__vg_rule.rule").alias("rule"),
        F.coalesce(F.col("__vg_rule.action"), F.when(F.col("__vg_bad"), "block"), F.lit("allow")).alias("verdict"),
        F.when(F.col("__vg_rule").isNotNull(), "rule").when(F.col("__vg_bad").isNotNull(), "host").otherwise("prior").alias("judged_by"),
    )
