"""URL verdicts from rules and, where no rule fits, from trust and distrust spread over the host graph.

DataFrame functions only.  Rules name a host, with all its subdomains, and the start of a path; the
longest that fits decides.  Hosts of which the larger part of pages is allowed (blocked) by rules
are the trusted (blocked) seeds.  Personalised PageRank carries trust from trusted seeds along the
links between hosts, and distrust from blocked seeds against them: who links to blocked hosts is
suspect.  A host is blocked if its distrust is above ``margin`` times its trust.

All steps on links work on one row per pair of hosts; ranks are one row per host.  Pages are joined
with their host's row, a join that adaptive execution splits for hosts with very many pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augurlog.session import materialise

DAMPING = 0.85
ITERATIONS = 15
#: Share of a host's pages that rules must allow or block to make it a seed.
SEED_SHARE = 0.5
MARGIN = 1.0
#: Ranks are written out after so many iterations, to keep plans short.
WRITE_EVERY = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/"'?#\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or no ``://``."""
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def suffixes(host: Column) -> Column:
    """A host and all the domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules for every host that has some, longest first."""
    each = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host"))
    named = rules.select(F.col("host").alias("rule_host"), "path", "verdict").where("rule_host is not null AND path is not null").distinct()
    fit = each.join(named, "rule_host").select("host", F.struct(
        (-(F.length("rule_host") + F.length("path"))).alias("order"), F.concat("rule_host", "path").alias("rule"), "path", "verdict",
    ).alias("r"))
    return fit.groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("rules"))


def host_links(pages: DataFrame, html: str) -> DataFrame:
    """(src, dst, share): links between different hosts, as shares of all such links of src."""
    found = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("to"))
    links = found.select(F.col("host").alias("src"), F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, links: DataFrame, source: str, target: str) -> DataFrame:
    """(host, rank): personalised PageRank from ``seeds`` (host, weight) along ``links`` from source to target.

    Rank that reaches a host without onward links ends there.
    """
    out = links.groupBy(source).agg(F.sum("n").alias("total"))
    shares = materialise(links.join(out, source).select(F.col(source).alias("host"), F.col(target).alias("to"), (F.col("n") / F.col("total")).alias("share")), "link_shares")
    total = seeds.agg(F.sum("weight")).first()[0] or 1.0
    start = materialise(seeds.select("host", (F.col("weight") / F.lit(float(total))).alias("rank")), "seeds")
    rank = start
    # Without links every step gives the same ranks.
    for step in range(1, (1 if shares.isEmpty() else ITERATIONS) + 1):
        moved = rank.join(shares, "host").select(F.col("to").alias("host"), (F.lit(DAMPING) * F.col("rank") * F.col("share")).alias("rank"))
        restart = start.select("host", (F.lit(1 - DAMPING) * F.col("rank")).alias("rank"))
        rank = moved.union(restart).groupBy("host").agg(F.sum("rank").alias("rank"))
        if step % WRITE_EVERY == 0:
            rank = materialise(rank, "ranks")
    return rank


def judged(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", seed_share: float = SEED_SHARE, margin: float = MARGIN) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) of every page.

    rule is null where none fits; then the verdict is the host's, seeds included.  Hosts that no rank
    reaches, and pages without a host, are allowed.  Rules without a host or path are ignored; of rules with the
    same host and path the one whose verdict sorts first counts.  Null html has no links.  Repeated
    rows are judged alike; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url))
    narrow = materialise(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")), "page_hosts")
    hosts = narrow.where("host <> ''").select("host").distinct()
    fitting = materialise(host_rules(hosts, rules), "host_rules")
    ruled = narrow.join(fitting, "host", "left").withColumn("hit", F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), F.lit(0)))
    links = materialise(host_links(pages.select(host.alias("host"), F.col(html).alias("html")), "html"), "host_links")
    share = lambda v: F.avg(F.coalesce((F.col("hit.verdict") == v).cast("double"), F.lit(0.0)))
    shares = materialise(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("allow"), share("block").alias("block")), "seed_shares")
    trusted = spread(shares.where(F.col("allow") >= seed_share).select("host", F.col("allow").alias("weight")), links, "src", "dst")
    blocked = spread(shares.where(F.col("block") >= seed_share).select("host", F.col("block").alias("weight")), links, "dst", "src")
    both = trusted.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).union(blocked.select("host", F.lit(0.0), "rank"))
    both = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    verdicts = both.where(F.col("distrust") > F.lit(margin) * F.col("trust")).select("host", F.lit("block").alias("host_verdict"))
    out = ruled.join(verdicts, "host", "left")
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "host_verdict", F.lit("allow")).alias("verdict"))
