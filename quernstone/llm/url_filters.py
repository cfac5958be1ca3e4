"""URL filters: explicit rules first, and for other urls trust and distrust that spread over host links.

Links between hosts are counted from the anchors of all pages. Trust is a personalised PageRank from the
trusted hosts along the links, distrust one from the blocked hosts against them. Each starts with a mass of 1, dealt
evenly to its seeds, and mass at hosts without a way on goes back to the seeds, so both stay 1 and can be compared. A
host with at least BLOCK_SHARE of its mass in distrust is blocked; a host that neither reaches is allowed.

Trusted seeds are hosts with more than SEED_SHARE of their urls decided by an allow rule, blocked seeds those with as many
decided by a block rule; a list of further blocked hosts may be given. A host of both kinds counts as blocked. No seed
turns a rule's verdict.

Nulls: a null url, or one without "://", has an empty host and path, fits no rule and is allowed; null html
has no links. Equal-length rules: the one listed first wins. Repeated pages are separate rows, and each
counts for the links. An empty table gives no rows. Rounds go on until all ranks together move by at most SETTLED;
if they don't within ROUNDS rounds, that is an error.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rounds, cut, heavy_keys, join_salted, join_spread

# The rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, ROUNDS, SETTLED, BLOCK_SHARE, SEED_SHARE = 0.85, 300, 1e-6, 0.5, 0.5


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """A struct of rule and verdict, both null where no rule fits."""
    chosen = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): how often pages of one host link to another host."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(anchors).alias("link"))
    links = links.withColumn("dst", lower_ascii(F.regexp_extract("link", r"//([^/?#]*)", 1)))
    return links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def spread(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """hosts (host, trusted, blocked: 1 for seeds) to (host, trust, distrust) of the hosts that either reaches."""
    out = links.groupBy("src").agg(F.sum("weight").alias("all"))
    into = links.groupBy("dst").agg(F.sum("weight").alias("all"))
    ahead = join_spread(links, out, "src", ["dst"]).select(F.lit("trust").alias("rank"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("weight") / F.col("all")).alias("share"))
    back = join_spread(links, into, "dst", ["src"]).select(F.lit("distrust").alias("rank"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("weight") / F.col("all")).alias("share"))
    steps = cut(ahead.unionByName(back), "host-steps")  # a step for each rank and link
    heavy = heavy_keys(steps, ["rank", "host"])
    leads_on = steps.select("rank", "host").distinct()
    marked = hosts.select("host", F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(c).alias("seed")) for r, c in (("trust", "trusted"), ("distrust", "blocked"))])).alias("m"))
    marked = cut(marked.select("m.rank", "host", "m.seed").where("seed > 0"), "host-marks")
    many = {r["rank"]: r["n"] for r in marked.groupBy("rank").agg(F.count("*").alias("n")).collect()}  # two rows
    share = F.when(F.col("rank") == "trust", 1.0 / many.get("trust", 1)).otherwise(1.0 / many.get("distrust", 1))
    ends = steps.select("rank", F.col("to").alias("host"))
    seeds = marked.select("rank", "host", share.alias("seed")).unionByName(ends.select("rank", "host", F.lit(0.0).alias("seed"))).groupBy("rank", "host").agg(F.sum("seed").alias("seed"))
    seeds = cut(seeds.join(leads_on.withColumn("on", F.lit(True)), ["rank", "host"], "left"), "host-seeds")
    ranks = seeds.select("rank", "host", "seed", "on", F.col("seed").alias("value"))
    tables = Rounds("host-ranks")
    for _ in range(ROUNDS):
        stuck = {r["rank"]: r["v"] for r in ranks.where("on is null").groupBy("rank").agg(F.sum("value").alias("v")).collect()}  # two rows
        moved = join_salted(steps, ranks.where("value > 0").select("rank", "host", "value"), ["rank", "host"], ["to"], "inner", heavy)
        moved = moved.groupBy("rank", F.col("to").alias("host")).agg(F.sum(F.col("share") * F.col("value")).alias("come"))
        again = F.when(F.col("rank") == "trust", stuck.get("trust", 0.0)).otherwise(stuck.get("distrust", 0.0))
        value = F.col("seed") * (1 - DAMPING + DAMPING * again) + DAMPING * F.coalesce("come", F.lit(0.0))
        new = tables.cut(ranks.withColumnRenamed("value", "old").join(moved, ["rank", "host"], "left").select("rank", "host", "seed", "on", "old", value.alias("value")))
        far = new.agg(F.sum(F.abs(F.col("value") - F.col("old")))).first()[0]
        ranks = new.drop("old")
        if far is None or far <= SETTLED:
            break
    else:
        raise RuntimeError(f"ranks of hosts: not settled after {ROUNDS} rounds")
    both = [F.sum(F.when(F.col("rank") == r, F.col("value")).otherwise(0.0)).alias(r) for r in ("trust", "distrust")]
    return ranks.where("value > 0").groupBy("host").agg(*both)


def judge(pages: DataFrame, rules: tuple = RULES, blocked_hosts: tuple[str, ...] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each page."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("chosen", rule_for(F.col("host"), F.col("path"), rules))
    decided = {v: F.avg((F.coalesce("chosen.verdict", F.lit("")) == v).cast("double")) for v in ("allow", "block")}
    shares = urls.groupBy("host").agg(decided["allow"].alias("allowed"), decided["block"].alias("blocked"))
    bad = (F.col("blocked") > SEED_SHARE) | F.col("host").isin(list(blocked_hosts))
    hosts = shares.select("host", F.when(bad, 0).otherwise((F.col("allowed") > SEED_SHARE).cast("int")).alias("trusted"), bad.cast("int").alias("blocked"))
    ranks = spread(cut(host_links(pages), "host-links"), hosts)
    mass = F.col("trust") + F.col("distrust")
    by_host = F.when((mass > 0) & (F.col("distrust") >= BLOCK_SHARE * mass), "block").otherwise("allow")
    return join_spread(urls, ranks, "host", ["page_id", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("chosen.rule").alias("rule"),
        F.coalesce("chosen.verdict", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
