"""URL rules, and trust and distrust of hosts propagated over links."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.sources.storage import materialize


@dataclass(frozen=True)
class Rule:
    """Judges urls on ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(text: str) -> Rule:
    """``"block example.com/en/"`` as a rule."""
    verdict, place = text.split()
    host, slash, path = place.partition("/")
    return Rule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, or null. Of equal texts the block rule wins."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.lit(r.text),
        )
        for r in ordered
    ]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links between different hosts: ``src``, ``dst`` and ``n``, the number of links."""
    target = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""
    links = pages.select(
        host_of(F.col(url)).alias("src"),
        F.explode(F.regexp_extract_all(F.col(html), F.lit(target), F.lit(1))).alias("link"),
    )
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(
        F.col("link")
    )
    found = links.select("src", host_of(full).alias("dst"))
    found = found.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(
    links: DataFrame,
    seeds: DataFrame,
    damping: float = 0.85,
    rounds: int = 30,
    tolerance: float = 1e-6,
    every: int = 5,
) -> DataFrame:
    """Mass that ``seeds`` (``host``, ``mass``) send along ``links``, as ``host`` and ``rank``.

    ``rank = (1 - damping) * mass + damping * (what the linking hosts pass on)``, each host
    passing on its rank in proportion to its links. A host without links keeps nothing of it.
    Every few rounds the ranks are written to the shared folder, which cuts the
    lineage, and the run ends when no rank moved by more than ``tolerance`` of all mass.
    """
    total = links.groupBy("src").agg(F.sum("n").alias("total"))
    shares = links.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("s"))
    shares = materialize(shares, "link-shares")
    start = seeds.select("host", ((1 - damping) * F.col("mass")).alias("rank"))
    start = materialize(start, "rank-seeds")
    if shares.isEmpty():
        return start
    whole = start.agg(F.sum("rank")).first()[0] or 0.0
    ranks = saved = start
    for i in range(1, rounds + 1):
        passed = ranks.join(shares, ranks["host"] == shares["src"]).select(
            F.col("dst").alias("host"), (damping * F.col("rank") * F.col("s")).alias("rank")
        )
        ranks = start.unionByName(passed).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % every == 0 or i == rounds:
            ranks = materialize(ranks, "ranks")
            old = saved.select("host", F.col("rank").alias("old"))
            moved = ranks.join(old, "host", "left").agg(
                F.max(F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0))))
            )
            if (moved.first()[0] or 0.0) <= tolerance * whole:
                break
            saved = ranks
    return ranks


def distrust_of_links(links: DataFrame, known: DataFrame, damping: float = 0.85) -> DataFrame:
    """``host`` and ``per_link``: how far the hosts that its links lead to are distrusted.

    A link counts from 0 to 1, by the ``distrust`` of its target (``known``, with ``pages``)
    over what it would be if all of the target's pages were seeds.
    """
    share = F.least(F.col("distrust") / ((1 - damping) * F.col("pages")), F.lit(1.0))
    targets = known.select(F.col("host").alias("dst"), share.alias("share"))
    return (
        links.join(targets, "dst", "left")
        .groupBy(F.col("src").alias("host"))
        .agg((F.sum(F.col("n") * F.coalesce("share", F.lit(0.0))) / F.sum("n")).alias("per_link"))
    )


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    damping: float = 0.85,
    threshold: float = 0.5,
    link_threshold: float = 0.25,
    rounds: int = 30,
) -> DataFrame:
    """Judge every url by the longest rule that fits, else by what is known of its host.

    A host's seed mass is its number of pages that a rule allows or blocks. Trust runs along the
    links from allowed seeds, distrust against them from blocked ones: who links to blocked
    hosts is distrusted. Without a rule, a url is blocked if its host has more distrust than
    trust (equal ones are allowed) and either a share of ``threshold`` of blocked pages, or links
    that by ``distrust_of_links`` are worth ``link_threshold`` on average. So neither the number
    of the host's pages nor that of other hosts with the same links matters.

    Urls that are null or have no ``://`` have an empty host and path and are allowed, having
    neither rule nor links. Rows with equal or null keys are judged on their own. Other
    columns aren't read.

    Returns ``key``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust``.
    """
    verdict_of = {r.text: r.verdict for r in sorted(rules, key=lambda r: r.verdict == "block")}
    blocked = [t for t, v in verdict_of.items() if v == "block"]
    parts = pages.select(
        F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    parts = parts.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    block = F.col("rule").isin(blocked)
    hosts = materialize(
        parts.filter(F.col("host") != "")
        .groupBy("host")
        .agg(
            F.count("*").alias("pages"),
            F.count_if(F.col("rule").isNotNull() & ~block).cast("double").alias("allowed"),
            F.count_if(F.col("rule").isNotNull() & block).cast("double").alias("blocked"),
        ),
        "hosts",
    )
    links = materialize(host_links(pages, url, html), "host-links")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")

    def spread(over: DataFrame, seed: str, name: str) -> DataFrame:
        seeds = hosts.filter(F.col(seed) > 0).select("host", F.col(seed).alias("mass"))
        ranks = personalised_rank(over, seeds, damping, rounds)
        return ranks.withColumnRenamed("rank", name)

    known = (
        hosts.join(spread(links, "allowed", "trust"), "host", "left")
        .join(spread(back, "blocked", "distrust"), "host", "left")
        .fillna(0.0, ["trust", "distrust"])
    )
    known = materialize(known, "host-ranks")
    known = known.join(distrust_of_links(links, known, damping), "host", "left")
    bad = (F.col("distrust") > F.col("trust")) & (
        (F.col("blocked") >= threshold * F.col("pages"))
        | (F.coalesce("per_link", F.lit(0.0)) >= link_threshold)
    )
    known = known.select("host", "trust", "distrust", bad.alias("bad"))
    ruled = F.when(block, "block").when(F.col("rule").isNotNull(), "allow")
    by_host = F.when(F.col("bad"), "block").otherwise("allow")
    return parts.join(known, "host", "left").select(
        F.col("k").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce(ruled, by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
