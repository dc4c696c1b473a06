"""URL filter: rules by host and path, and for all other pages trust and distrust over the host graph.

A host has an edge to each host that its pages link to, and, as hosts of one domain answer for each other,
between a host and its parent domain. Trust starts from the pages that a rule allows and follows the edges
(personalised PageRank); distrust starts from the pages that a rule blocks and follows them backwards, from a
blocked host to those that link to it. A host's distrust as a share of its trust and distrust, both counted
in pages, is its suspicion. A page without a rule is blocked if its host's suspicion is above a bound that
separates the judged pages best, by what reaches their hosts from others.
"""

from __future__ import annotations

from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayfold.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host of an absolute or protocol-relative link in a start tag's attribute.
LINK = r"""(?i)\s(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>\\]+)"""
DAMPING = 0.85
ROUNDS = 16
#: The bound without judged pages of both kinds to find it by.
EVEN = 0.5
#: Steps of suspicion between which the bound is sought.
STEPS = 1000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: Fixed values of the contract.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def _lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty for a null or a url without `://`."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    pattern = r"^([^/?#]*)([^?#]*)"
    return _lower(F.regexp_extract(after, pattern, 1)), F.regexp_extract(after, pattern, 2)


def matching(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different hosts of `pages` (host, html)."""
    links = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))))
    linked = pages.where("host <> ''").select(F.col("host").alias("src"), links.alias("dst")).select("src", _lower(F.col("dst")).alias("dst")).distinct()
    hosts = pages.where("host <> ''").select("host").distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    family = hosts.select("host", parent.alias("parent")).where("parent <> ''")
    both = family.select("host", "parent").union(family.select("parent", "host"))
    return linked.union(both).where("src <> dst").distinct().toDF("src", "dst")


def host_trust(pages: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, excess, suspicion, reached, n_good, n_bad) of each host.

    `excess` is distrust less trust, both relative to the plain PageRank; `suspicion` the share of distrust,
    null where neither came; `reached` the same of what came from other hosts; then the judged pages.
    `pages` has host, html and verdict (allow, block or null by rule).
    """
    pages = pages.where("host <> ''")
    edges = written(host_edges(pages), "hosts")
    forth = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    back = edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    weighted = edges.join(forth, "src").join(back, "dst")
    zero = F.lit(0.0)
    moves = weighted.select(F.col("src").alias("host"), F.col("dst").alias("to"), (1 / F.col("n_out")).alias("ahead"), zero.alias("behind")).union(
        weighted.select("dst", "src", zero, 1 / F.col("n_in"))
    )
    moves = written(moves.groupBy("host", "to").agg(F.sum("ahead").alias("ahead"), F.sum("behind").alias("behind")), "moves")
    seeds = pages.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"), F.count("*").alias("plain"))
    nodes = seeds.select("host", "good", "bad", "plain").union(edges.select(F.explode(F.array("src", "dst")).alias("host")).select("host", *[F.lit(0).cast("long")] * 3))
    nodes = nodes.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("good", "bad", "plain")])
    total = nodes.agg(*[F.greatest(F.sum(c), F.lit(1)).alias(c) for c in ("good", "bad", "plain")]).first()
    if total is None or total["plain"] is None:
        return nodes.select("host", F.lit(0.0).alias("excess"), *[F.lit(None).cast("double").alias(c) for c in ("suspicion", "reached")], F.col("good").alias("n_good"), F.col("bad").alias("n_bad"))
    nodes = written(nodes.select("host", F.col("good").alias("n_good"), F.col("bad").alias("n_bad"), *[(F.col(c) / F.lit(float(total[c]))).alias(f"seed_{c}") for c in ("good", "bad", "plain")]), "seeds")
    names = ("good", "bad", "plain")
    ranks = nodes.select("*", *[F.col(f"seed_{c}").alias(c) for c in names])
    for i in range(rounds):
        moved = moves.join(ranks.select("host", *names), "host").groupBy(F.col("to").alias("host")).agg(
            F.sum(F.col("good") * F.col("ahead")).alias("in_good"), F.sum(F.col("bad") * F.col("behind")).alias("in_bad"), F.sum(F.col("plain") * F.col("ahead")).alias("in_plain")
        )
        ranks = nodes.join(moved, "host", "left").select(
            "host", *[f"seed_{c}" for c in names], *[((1 - DAMPING) * F.col(f"seed_{c}") + DAMPING * F.coalesce(f"in_{c}", zero)).alias(c) for c in names]
        )
        if i % 4 == 3:
            ranks = written(ranks, "ranks")
    plain = F.greatest("plain", F.lit(1e-300))
    good, bad = (F.col(c) * float(total[c]) for c in ("good", "bad"))
    far_good, far_bad = (F.greatest((F.col(c) - (1 - DAMPING) * F.col(f"seed_{c}")) * float(total[c]), zero) for c in ("good", "bad"))
    share = lambda b, g: F.when(b + g > 1e-12, b / (b + g))
    found = ranks.join(nodes.select("host", "n_good", "n_bad"), "host")
    return found.select("host", ((F.col("bad") - F.col("good")) / plain).alias("excess"), share(bad, good).alias("suspicion"), share(far_bad, far_good).alias("reached"), "n_good", "n_bad")


def bound(trust: DataFrame) -> float:
    """The suspicion above which hosts have most of the blocked and least of the allowed pages by rule.

    Among equally good bounds it is the middle one.
    """
    step = F.round(F.col("reached") * STEPS).cast("int").alias("step")
    rows = trust.where("reached is not null").groupBy(step).agg(F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad")).collect()  # one row for each step at most
    good, bad = [0] * (STEPS + 1), [0] * (STEPS + 1)
    for r in rows:
        good[r["step"]], bad[r["step"]] = r["good"], r["bad"]
    n_good, n_bad = sum(good), sum(bad)
    if not n_good or not n_bad:
        return EVEN
    kept = list(zip(accumulate(good), accumulate(bad)))[:STEPS]  # pages at or under each bound
    gains = [g * n_bad - b * n_good for g, b in kept]
    best = [i for i, x in enumerate(gains) if x == max(gains)]
    return (best[len(best) // 2] + 0.5) / STEPS if max(gains) > 0 else EVEN


def judged_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, excess.

    Every page without a rule gets its host's verdict; one without a host (null url, no `://`) is allowed.
    Repeated rows count as pages of their own; a null html has no links; an empty table gives no row.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = matching(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    trust = written(host_trust(parsed.select("host", "html", F.col("by_rule").alias("verdict"))), "trust")
    by_host = F.when(F.coalesce("suspicion", F.lit(0.0)) > bound(trust), "block").otherwise("allow")
    rows = parsed.select("page_id", "host", "path", "rule", "by_rule").join(trust.select("host", "excess", "suspicion"), "host", "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"), "excess")


def op6_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
