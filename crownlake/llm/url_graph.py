"""URL filters with link-graph propagation; DataFrame functions only.

A url is judged by the longest rule that fits it. Where none fits, its host is judged: trust flows
from hosts whose pages the rules allow along links (personalised PageRank), distrust flows from hosts
whose pages the rules block against the links, and a host whose distrust outweighs its trust is
blocked.

Scale: pages are reduced to distinct host pairs with partial sums before the shuffle, so a hub host
costs one row per neighbour. An iteration is one join and one sum over hosts for both directions
together, cut off by a reliable checkpoint. Hosts are broadcast to pages only below a checked number;
beyond it the join is a shuffle join, whose hot keys AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Most hosts that are broadcast (some 100 bytes each).
BROADCAST_HOSTS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path) and its verdict, as column expressions; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, pages: distinct links between different hosts, by absolute href or src in the html."""
    host, _ = url_parts(F.col(url))
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), 1), lambda x: F.translate(x, _UPPER, _LOWER)))
    return (
        pages.select(host.alias("src"), F.explode(links).alias("dst"))
        .filter((F.col("src") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst").agg(F.count("*").alias("pages"))
    )


def propagate(seeds: DataFrame, edges: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """host, trust, distrust from seeds (host, trust, distrust) over edges (src, dst, pages).

    Two personalised PageRanks, each of mass 1: seeds are normalised to shares s, and
    rank = (1 - damping) * s + damping * (inflow + lost * s), where inflow goes along links (for distrust
    against them), each host passing its rank on in proportion to ``pages``, and lost is the rank of hosts without
    such links. What a round moves shrinks by ``damping`` at least, so rounds end by themselves: when the ranks move
    by ``tolerance`` of their mass or less in sum. A kind without seeds has rank 0 everywhere.
    """
    c = F.col
    split = lambda kind, a, b: edges.select(F.lit(kind).alias("kind"), c(a).alias("frm"), c(b).alias("to"), "pages")
    arcs = split("trust", "src", "dst").unionByName(split("distrust", "dst", "src"))
    out = arcs.groupBy("kind", "frm").agg(F.sum("pages").alias("all"))
    arcs = checkpointed(arcs.join(out, ["kind", "frm"]).select("kind", "frm", "to", (c("pages") / c("all")).alias("w")))
    seed = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed"))
    sums = seed.groupBy("kind").agg(F.sum("seed").alias("mass"))
    hosts = seed.unionByName(arcs.select(c("to").alias("host"), "kind", F.lit(0.0).alias("seed"))).unionByName(arcs.select(c("frm").alias("host"), "kind", F.lit(0.0).alias("seed")))
    hosts = hosts.groupBy("kind", "host").agg(F.sum("seed").alias("seed")).join(F.broadcast(sums), "kind")
    ends = hosts.join(out.select("kind", c("frm").alias("host"), F.lit(False).alias("ends")), ["kind", "host"], "left")
    share = F.when(c("mass") > 0, c("seed") / c("mass")).otherwise(0.0)
    rank = checkpointed(ends.select("kind", "host", share.alias("seed"), F.coalesce("ends", F.lit(True)).alias("ends"), share.alias("rank")))
    while not arcs.isEmpty():
        lost = rank.groupBy("kind").agg(F.sum(F.when(c("ends"), c("rank")).otherwise(0.0)).alias("lost"))
        inflow = arcs.join(rank.select("kind", c("host").alias("frm"), "rank"), ["kind", "frm"]).groupBy("kind", c("to").alias("host")).agg(F.sum(c("w") * c("rank")).alias("inflow"))
        new = c("seed") * (1 - damping + damping * c("lost")) + F.coalesce("inflow", F.lit(0.0)) * damping
        moved = rank.join(F.broadcast(lost), "kind").join(inflow, ["kind", "host"], "left")
        moved = checkpointed(moved.select("kind", "host", "seed", "ends", new.alias("rank"), F.abs(new - c("rank")).alias("moved")))
        rank = moved.drop("moved")
        if (moved.groupBy("kind").agg(F.sum("moved").alias("m")).agg(F.max("m")).first()[0] or 0.0) <= tolerance:
            break
    of = lambda kind: F.sum(F.when(c("kind") == kind, c("rank")).otherwise(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def filter_urls(
    pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", rules: list[tuple[str, str, str]] | None = None,
    damping: float = 0.85, threshold: float = 0.5, otherwise: str = "allow",
) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict, trust, distrust.

    The verdict is the rule's; without one, ``block`` if distrust / (trust + distrust) of the host is
    over ``threshold``; a host that neither reaches (an empty host too) gets ``otherwise``. A host's
    seeds are the shares of its pages that rules allow and block; ranks are scaled to the sums of the seeds. Null urls have an empty host and
    path; null html has no links; repeated rows keep their rows and count as pages; an empty table
    gives an empty result. Other columns of ``pages`` are not read.
    """
    host, path = url_parts(F.col(url))
    judged = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path")).select("*", *(c.alias(n) for c, n in zip(rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules), ("rule", "ruled"), strict=True)))
    share = lambda kind: F.avg(F.when(F.col("ruled") == kind, 1.0).otherwise(0.0))
    seeds = checkpointed(judged.filter("host != ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")))
    # each kind has as much rank as it has seeds, so that a host without links keeps the balance of its own pages
    masses = seeds.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in ("trust", "distrust"))).first()
    ranks = propagate(seeds, host_edges(pages, url=url, html=html), damping=damping)
    scores = checkpointed(ranks.select("host", *((F.col(x) * m).alias(x) for x, m in zip(("trust", "distrust"), masses, strict=True))))
    mass = F.col("trust") + F.col("distrust")
    ruling = F.when(mass > 0, F.when(F.col("distrust") / mass > threshold, "block").otherwise("allow")).otherwise(F.lit(otherwise))
    scores = scores.select("host", "trust", "distrust", ruling.alias("host_verdict"))
    if scores.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        scores = F.broadcast(scores)
    return judged.join(scores, "host", "left").select(
        F.col("k").alias(key), "host", "path", "rule", F.coalesce("ruled", "host_verdict", F.lit(otherwise)).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
