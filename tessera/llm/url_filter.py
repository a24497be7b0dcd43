"""URL filtering by rules and by trust that flows over the host link graph; built-in functions only.

Rules come first: a rule (host, path, action) fits a url if the url's host is the
rule's host or a subdomain of it and the url's path starts with the rule's path.
The longest rule wins (block before allow at equal length).

Urls that no rule fits are judged per host. Pages that an allow rule fits seed
trust at their host, pages that a block rule fits seed distrust there.
Personalised PageRank carries trust along links and distrust against them (a
page that links to a blocked host is suspect). A host is blocked if its distrust exceeds
``ratio`` times its trust; hosts that neither reaches are allowed.

Ranks are doubles, so a share keeps its value however many seeds and links it is
divided by. They are summed as decimals, by classes of 12 powers of ten, so the result
does not depend on the order of summation. Ranks that differ by less than rounding
(``TIE``) count as equal.

Scale: pages are reduced to distinct (source host, target host) edges with
counts, by partial aggregation, before anything is joined; each round moves the host graph
only, and is cut by a written table in the shared folder.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits
no rule, and is allowed unless distrust reaches the empty host (it has no
links). A null html has no links. Repeated rows count as often as they occur. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch

#: Rank that is shared out (in the reference query in whole units).
UNITS = 1_000_000_000_000
#: Rounds of propagation; what further rounds would move is below 0.85 ** 12 of the budget.
ROUNDS = 12
#: Percent of a host's rank that flows on; the rest returns to the seeds.
DAMPING = 85
#: Relative difference that rounding can make in ``ROUNDS`` rounds.
TIE = 1e-13

Rule = tuple[str, str, str]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits, else null. One expression: no join, no shuffle."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for h, p, _ in ordered]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values)], F.lit(None).cast("string"))
    return pick([h + p for h, p, _ in ordered]), pick([a for *_, a in ordered])


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: absolute and protocol-relative links between different hosts, counted."""
    links = F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']?((?:https?:)?//[^\"'\s>]+)"), F.lit(1)))
    found = pages.select(host_of(F.col("url")).alias("src"), links.alias("link"))
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return found.select("src", host_of(target).alias("dst")).filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("w"))


def _sum_by_host(parts: DataFrame) -> DataFrame:
    """host, rank: the sum of ``got``, in any order the same. A host has one row for every class of 12 powers of ten."""
    power = F.floor(F.log10("got") / 12).cast("int")
    digits = F.expr("cast(got * pow(10D, -12 * power) as decimal(29,16))")
    sums = parts.filter("got > 0").withColumn("power", power).groupBy("host", "power").agg(F.sum(digits).alias("digits"))
    return sums.groupBy("host").agg(F.expr("aggregate(array_sort(collect_list(struct(power, digits))), 0D, (a, x) -> a + cast(x.digits as double) * pow(10D, 12 * x.power))").alias("rank"))


def _propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """host, rank after ``ROUNDS`` rounds. edges: src, dst, w; seeds: host, n."""
    total = seeds.agg(F.sum("n")).first()[0] or 0
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank")).limit(0)
    home = seeds.select("host", (F.col("n") / F.lit(float(total)) * F.lit(float(UNITS))).alias("home"))
    outs = edges.groupBy("src").agg(F.sum("w").alias("out"))
    shares = scratch.save(edges.join(outs, "src"), f"{name}-shares")
    rank = home.select("host", F.col("home").alias("rank"))
    if not shares.take(1):
        return rank  # no link leaves any host: rank stays with the seeds
    for i in range(ROUNDS):
        sent = shares.join(rank, shares.src == rank.host).select(F.col("dst").alias("host"), (F.col("rank") * DAMPING / 100 * F.col("w") / F.col("out")).alias("got"))
        kept = home.select("host", (F.col("home") * (100 - DAMPING) / 100).alias("got"))
        rank = scratch.save(_sum_by_host(sent.unionByName(kept)), f"{name}-{i}")
        if i:
            scratch.drop(f"{name}-{i - 1}")
    return rank


def judge_urls(pages: DataFrame, rules: list[Rule], ratio: int = 1, key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule, action of the rule, host's verdict by propagation, verdict."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, action = match_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("action", action)
    hosts = scratch.save(judged.groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked")), "hosts")
    edges = scratch.save(host_edges(pages), "edges")
    trust = _propagate(edges, hosts.filter("allowed > 0").select("host", F.col("allowed").alias("n")), scratch, "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = _propagate(back, hosts.filter("blocked > 0").select("host", F.col("blocked").alias("n")), scratch, "distrust")
    blocked = distrust.filter("host <> ''").select("host", F.col("rank").alias("distrust")).join(trust.select("host", F.col("rank").alias("trust")), "host", "left").filter(F.col("distrust") > ratio * F.coalesce("trust", F.lit(0.0)) * (1 + TIE))
    blocked = scratch.save(blocked.select("host", F.lit("block").alias("by_host")), "blocked")
    # only hosts that distrust reached; joined by a shuffle of narrow rows unless Spark finds it small enough to send around
    out = judged.join(blocked, "host", "left")
    return out.select(key, "host", "path", "rule", F.coalesce("action", "by_host", F.lit("allow")).alias("verdict"))


def rules_sql(rules: list[Rule]) -> str:
    """A VALUES list of the rules, for a reference query."""
    return reduce(lambda a, b: f"{a}, {b}", [f"('{h}', '{p}', '{a}')" for h, p, a in rules])
