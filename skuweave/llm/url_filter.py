"""URL filters: rules first, then trust and distrust spread over links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Absolute links of a page, with or without a scheme.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""

#: Trust and distrust are whole numbers, so that no order of adding changes them.
UNIT = 1_000_000_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                  "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct(rule, verdict), or NULL."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
            for verdict, h, p in longest]
    return F.coalesce(*fits)


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html",
               parents: bool = True) -> DataFrame:
    """(src, dst, links): links between different hosts, counted before the shuffle.

    With `parents`, every host below a registered domain also has one link to and one
    from its parent (a.b.org and b.org), because one owner runs both.
    """
    hosts = host_of(F.col(url_col))
    named = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1))
    # A link without scheme gets one, so that its host is read by the same rule.
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(
        F.col("link"))
    linked = pages.select(hosts.alias("src"), named.alias("link")).select(
        "src", host_of(target).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    found = linked.groupBy("src", "dst").agg(F.count("*").alias("links"))
    if not parents:
        return found
    names = pages.select(hosts.alias("host")).distinct().withColumn("part", F.split("host", r"\."))
    chain = names.where(F.size("part") > 2).select("host", "part", F.explode(
        F.sequence(F.lit(1), F.size("part") - 2)).alias("k"))

    def tail(k: Column) -> Column:
        return F.array_join(F.slice("part", k, F.size("part")), ".")

    up = chain.select(tail(F.col("k")).alias("src"), tail(F.col("k") + 1).alias("dst")).distinct()
    both = up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return found.union(both.withColumn("links", F.lit(1).cast("long"))).groupBy("src", "dst").agg(
        F.sum("links").alias("links"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int, keep_percent: int = 85) -> DataFrame:
    """Personalised PageRank in whole numbers: (host, mass).

    seeds has (host, pages); a host starts with UNIT times its share of all seed pages,
    and gets 15 % of that in every round. 85 % of a host's mass goes along its links in
    proportion to their number; mass of hosts without links goes nowhere. A round is one
    join by source and one sum by target, both on hosts, and is written to the shared
    folder, so no round is computed twice.
    """
    everything = seeds.agg(F.sum("pages")).first()[0] or 1
    start = stage(seeds.select("host", F.expr(f"pages * {UNIT} div {everything}").alias("seed")),
                  "seeds")
    out = links.groupBy("src").agg(F.sum("links").alias("out"))
    shares = stage(links.join(out, "src").select("src", "dst", "links", "out"), "shares")
    mass = start.select("host", F.col("seed").alias("mass"))
    for _ in range(rounds):
        sent = mass.join(shares, mass.host == shares.src).select(
            F.col("dst").alias("host"),
            F.expr(f"mass * {keep_percent} * links div (100 * out)").alias("mass"))
        kept = start.select("host", F.expr(f"seed * {100 - keep_percent} div 100").alias("mass"))
        mass = stage(sent.union(kept).groupBy("host").agg(F.sum("mass").alias("mass")), "mass")
    return mass


def host_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url",
                  html_col: str = "html", rounds: int = 8, parents: bool = True,
                  tolerance: int = 1) -> DataFrame:
    """(host, trust, distrust, verdict) for every host.

    Trust starts at the hosts of pages that a rule allows and follows links; distrust
    starts at the hosts of pages that a rule blocks and goes against the links, to those
    who link there. A host is blocked when its distrust exceeds `tolerance` times its
    trust; hosts that neither reaches are allowed.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    hosts = stage(pages.select(host.alias("host"), rule_of(host, path, rules)["verdict"].alias("v"))
                  .groupBy("host").agg(F.count(F.when(F.col("v") == "allow", 1)).alias("allowed"),
                                       F.count(F.when(F.col("v") == "block", 1)).alias("blocked")),
                  "hosts")
    links = stage(host_links(pages, url_col, html_col, parents), "links")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = propagate(links, hosts.where("allowed > 0").select(
        "host", F.col("allowed").alias("pages")), rounds)
    distrust = propagate(back, hosts.where("blocked > 0").select(
        "host", F.col("blocked").alias("pages")), rounds)
    judged = (hosts.select("host").join(trust.withColumnRenamed("mass", "trust"), "host", "left")
              .join(distrust.withColumnRenamed("mass", "distrust"), "host", "left")
              .fillna(0, ["trust", "distrust"]))
    return judged.withColumn("verdict", F.when(
        F.col("distrust") > tolerance * F.col("trust"), "block").otherwise("allow"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id",
                 url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    The longest rule that fits decides; without one, the verdict of the host does. Hosts
    are joined to pages by name; AQE splits a host with very many pages, or sends the
    host table to all tasks when it is small.

    NULL URLs and those without `://` have an empty host and path, fit no rule and are
    allowed, as no link leads to them; NULL html has no links; NULL and repeated ids pass.
    """
    hosts = stage(host_verdicts(pages, rules, url_col, html_col, **options).select(
        F.col("host").alias("h"), F.col("verdict").alias("of_host")), "verdicts")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"),
                        rule_of(host, path, rules).alias("r"))
    return rows.join(hosts, F.col("host") == F.col("h"), "left").select(
        id_col, "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", "of_host").alias("verdict"))
