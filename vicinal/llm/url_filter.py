"""URL filter: host and path rules, then empirical-Bayes reputation of the host.

A page's host and path are cut from its url. The longest rule that fits decides. Otherwise the
verdict is the host's: labelled outcomes of its pages are shrunk through beta-binomial priors,
from all pages to the suffix (last label), to the registered domain (last two labels), to the
host. The strength of each level's prior is the ANOVA estimate of the intra-group correlation, so
levels whose groups differ little are shrunk much. A host is blocked when the lower posterior
bound of its share of bad pages is above ``max_bad``.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
gets the reputation of the empty host. Null outcomes do not count. Repeated rows count each time; of equally long rules that fit the last decides.
An empty table gives an empty result. Extra columns are kept, but those named like a result's are replaced, and names that
begin with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (action, host, path prefix)
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The text and the action of the longest rule that fits, or nulls. For a short list of rules."""
    text = action = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        text = F.when(fits, F.lit(name + start)).otherwise(text)
        action = F.when(fits, F.lit(what)).otherwise(action)
    return text, action


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain (last two labels) and suffix (last label), without a port."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    return F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -1)


def strength(groups: DataFrame, least: float = 2.0, most: float = 200.0) -> float:
    """Prior strength (pseudo-counts) of a level from its groups' ``n`` and ``bad``."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    s = groups.where("n > 0").agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(bad).alias("b"),
        F.sum(bad * bad / n).alias("bb"),
    ).first()
    k, total = s["k"], s["n"] or 0.0
    if k < 2 or total <= k:
        return most
    between = (s["bb"] - s["b"] ** 2 / total) / (k - 1)
    within = (s["b"] - s["bb"]) / (total - k)
    typical = (total - s["nn"] / total) / (k - 1)
    rho = (between - within) / d if (d := between + (typical - 1) * within) > 0 else 0.0
    return most if rho <= 0 else min(most, max(least, 1 / rho - 1))


def reputation(labelled: DataFrame, z: float = 1.645) -> DataFrame:
    """``host, n, bad, lower``: lower posterior bound of the share of bad pages of each host.

    ``labelled`` has host and bad (boolean), one row per labelled page, and rows with a null bad for the other
    pages: a host of such rows only is as its domain's prior says, or its suffix's or that of all pages where those
    have no labels either. Counts are partial sums before any shuffle, so a host with a third of all pages is one
    row per task; each level then has a row per group. The pages are read once, the hosts' counts are written.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    # what follows reads these rows and never the pages again
    hosts = materialise(hosts.withColumns({"bad": F.coalesce("bad", F.lit(0)), "domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (whole["bad"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5
    k_suffix, k_domain, k_host = strength(suffixes), strength(domains), strength(hosts)
    shrunk = lambda k, prior: (F.col("bad") + k * prior) / (F.col("n") + k)
    suffixes = suffixes.select("suffix", shrunk(k_suffix, F.lit(mean)).alias("of_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(k_domain, F.col("of_suffix")).alias("of_domain"))
    hosts = hosts.join(domains, "domain").withColumn("mean", shrunk(k_host, F.col("of_domain")))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + k_host + 1))
    return hosts.select("host", "n", "bad", (F.col("mean") - z * spread).alias("lower"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], max_bad: float = 0.5, id_column: str = "page_id") -> DataFrame:
    """``pages`` with host, path, rule, verdict and the host's labelled counts.

    ``outcomes``: id_column and bad (boolean). Pages that have no outcome count in no reputation, but a host
    without any is judged too, by its domain's prior.
    """
    host, path = host_and_path(F.col("url"))
    cut = pages.drop("host", "path", "rule", "verdict", "n_labelled", "n_bad").withColumns({"host": host, "path": path})
    text, action = longest_rule(F.col("host"), F.col("path"), rules)
    cut = cut.withColumns({"rule": text, "__by_rule": action})
    seen = cut.select(id_column, "host").join(outcomes.select(id_column, "bad"), id_column, "left").select("host", "bad")
    known = reputation(seen).select("host", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), (F.col("lower") > max_bad).alias("__bad_host"))
    out = cut.join(known, "host", "left")
    verdict = F.coalesce("__by_rule", F.when(F.col("__bad_host"), "block").otherwise("allow"))
    return out.withColumns({"verdict": verdict, "n_labelled": F.coalesce("n_labelled", F.lit(0)), "n_bad": F.coalesce("n_bad", F.lit(0))}).drop("__by_rule", "__bad_host")
