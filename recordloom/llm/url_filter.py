"""URL verdicts by rules, and by trust and distrust that spread over host links.

Pages that a rule fits get the rule's verdict. For the rest the hosts decide.
Hosts whose pages rules allow are trusted seeds, hosts whose pages rules block
are distrusted seeds, each in proportion to those pages. Trust follows links
(personalised PageRank from the trusted seeds), distrust runs against them (the
same walk on reversed edges from the blocked seeds): who links to bad hosts is
suspect. A host whose distrust exceeds ``threshold`` times the sum of both is
blocked, every other host is allowed.

Edges are the links in a page's html to other hosts, weighted by their number:
absolute ones, those that start with ``//``, and a base address, which is where the
page's relative links lead. Besides, an edge in each direction connects a host of
three or more labels with the domain one label shorter, and so on up to two
labels. Such a domain is a node of the graph whether or not it has pages of its
own, so that hosts of one domain share their standing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


#: The production rules.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct of the longest fitting rule's text and verdict, null if none fits.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Longest is by the text's length; equal lengths fall back to block, then text.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        made = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, made).otherwise(found)
    return found


#: Attributes with a link to a host: of a link, or of the page's base address.
LINK = r"""(?i)<(?:a|base)\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>]+)"""


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``weight`` of links between different hosts.

    ``pages`` has host and html, ``hosts`` one row a host.
    """
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(LINK), 1)
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    linked = (
        pages.select(F.col("host").alias("src"), F.explode(links).alias("link"))
        .select("src", host_of(target).alias("dst"))
        .filter("dst <> '' and src <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    named = hosts.select("host").union(linked.select("dst")).distinct()
    labels = F.split("host", r"\.")
    chain = F.transform(
        F.sequence(F.lit(1), F.array_size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.array_size(labels)), ".")
    )
    rows = named.filter(F.array_size(labels) > 2).select(chain.alias("c"))
    up = (
        rows.select(F.explode(F.arrays_zip(F.slice("c", 1, F.array_size("c") - 1).alias("a"), F.slice("c", 2, F.array_size("c") - 1).alias("b"))).alias("e"))
        .select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"))
        .filter("src <> dst and src <> '' and dst <> ''")
        .distinct()
    )
    both = up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (
        linked.unionByName(both.withColumn("weight", F.lit(1.0)))
        .groupBy("src", "dst")
        .agg(F.sum("weight").alias("weight"))
    )


def rounds_for(damping: float, tolerance: float) -> int:
    """After so many rounds at most ``tolerance`` of all trust still moves, whatever the graph."""
    return max(1, math.ceil(math.log(tolerance) / math.log(damping)))


def propagate(
    hosts: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 0.01, keep_every: int = 5
) -> DataFrame:
    """``hosts`` (host, trust_seed, distrust_seed) with ``trust`` and ``distrust``.

    Both walks run together: an edge carries trust along its direction and
    distrust against it, in shares of the sender's edge weights; a sender
    without edges keeps nothing beyond its seed. Seeds are shares of 1. Each
    round is one join on the sender and one sum by receiver, pre-aggregated in
    the tasks; every ``keep_every`` rounds the ranks go to the shared folder. The
    walk ends when ranks stored one after the other differ by less than
    ``tolerance`` in all, at the latest after :func:`rounds_for`, from where on no
    graph has more than that left to move.
    """
    rounds = rounds_for(damping, tolerance)
    totals = hosts.agg(F.sum("trust_seed").alias("t"), F.sum("distrust_seed").alias("d")).first()
    share = lambda c, total: F.col(c) / F.lit(float(total)) if total else F.lit(0.0)
    seeds = stored(
        hosts.select(
            "host", share("trust_seed", totals["t"]).alias("t0"), share("distrust_seed", totals["d"]).alias("d0")
        ),
        "url-seeds",
    )
    directed = edges.select("src", "dst", "weight", F.lit(True).alias("forward")).union(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit(False))
    )
    sums = directed.groupBy("src", "forward").agg(F.sum("weight").alias("total"))
    flow = stored(
        directed.join(sums, ["src", "forward"]).select("src", "dst", "forward", (F.col("weight") / F.col("total")).alias("p")),
        "url-flow",
    )
    ranks = seeds.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    if flow.isEmpty():
        return seeds.select(
            "host", (F.col("t0") * (1 - damping)).alias("trust"), (F.col("d0") * (1 - damping)).alias("distrust")
        )
    last = ranks
    for k in range(1, rounds + 1):
        sent = (
            flow.join(ranks, flow["src"] == ranks["host"])
            .groupBy(F.col("dst").alias("host"))
            .agg(
                F.sum(F.when(F.col("forward"), F.col("p") * F.col("trust"))).alias("t"),
                F.sum(F.when(~F.col("forward"), F.col("p") * F.col("distrust"))).alias("d"),
            )
        )
        got = lambda c: F.coalesce(F.col(c), F.lit(0.0)) * damping
        ranks = seeds.join(sent, "host", "left").select(
            "host",
            (F.col("t0") * (1 - damping) + got("t")).alias("trust"),
            (F.col("d0") * (1 - damping) + got("d")).alias("distrust"),
        )
        if k % keep_every == 0 and k < rounds:
            ranks = stored(ranks, "url-ranks")
            old = [F.col(c).alias(f"old_{c}") for c in ("trust", "distrust")]
            both = ranks.join(last.select("host", *old), "host")
            moved = both.agg(F.sum(F.abs(F.col("trust") - F.col("old_trust"))).alias("t"), F.sum(F.abs(F.col("distrust") - F.col("old_distrust"))).alias("d")).first()
            if max(moved["t"], moved["d"]) < tolerance:
                break
            last = ranks
    return ranks


def judge(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, damping: float = 0.85, tolerance: float = 0.01
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``distrust_share``.

    ``rule`` is null where none fits; then ``verdict`` is the host's, and a page
    without a host is allowed. ``distrust_share`` is the host's distrust over
    the sum of both, null for hosts that neither walk reaches. Null or odd urls
    have an empty host and path. Very long html is searched whole for links, a null
    one has none. Repeated rows and null ids are kept, and a repeated row's links
    and rule count again; an empty table gives an empty result; other columns are
    ignored.
    """
    parts = pages.select(
        "page_id",
        host_of(F.col("url").cast("string")).alias("host"),
        path_of(F.col("url").cast("string")).alias("path"),
        F.col("html").cast("string").alias("html"),
    )
    fit = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumn("fit", fit).select("*", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruling"))
    hosts = stored(
        ruled.filter("host <> ''")
        .groupBy("host")
        .agg(
            F.count_if(F.col("ruling") == "allow").cast("double").alias("trust_seed"),
            F.count_if(F.col("ruling") == "block").cast("double").alias("distrust_seed"),
        ),
        "url-hosts",
    )
    edges = stored(host_edges(parts.select("host", "html"), hosts), "url-edges")
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    every = (
        hosts.unionByName(linked, allowMissingColumns=True)
        .groupBy("host")
        .agg(F.coalesce(F.sum("trust_seed"), F.lit(0.0)).alias("trust_seed"), F.coalesce(F.sum("distrust_seed"), F.lit(0.0)).alias("distrust_seed"))
    )
    ranks = propagate(every, edges, damping, tolerance)
    share = F.try_divide(F.col("distrust"), F.col("trust") + F.col("distrust"))
    scores = stored(ranks.select("host", share.alias("distrust_share")), "url-scores")
    bad = F.coalesce(F.round("distrust_share", 9) > threshold, F.lit(False))  # rounded: sums come in any order
    return ruled.select("page_id", "host", "path", "rule", "ruling").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruling", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "distrust_share",
    )
