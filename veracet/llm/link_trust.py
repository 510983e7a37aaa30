"""URL filter by link-graph propagation over hosts, with DataFrame functions only.

Rules decide the pages that they fit; for the others, trust flows from the hosts whose pages rules allow along the
links between hosts, and distrust from the hosts whose pages rules block against them (who links to a bad host
is suspect): two personalised PageRanks, each host's seed being the share of its pages so judged.  As a blocked host's
distrust is dealt among all that link to it, each host has a blame too: its seed, and for the rest ``DAMPING`` times the
mean blame of what it links to, however many others do so.  A host whose distrust or blame exceeds its trust by ``THRESHOLD``
is blocked.  Rounds go on until no score changes by more than ``TOLERANCE``; as each damps the change, they end.

Links are counted to (from, to, pages) first, so a host with a third of all pages is one row per neighbour from
then on.  Each round is a join and a grouped sum, written to the shared folder; only the largest change comes to
the driver.  A host without links out keeps nothing back (its mass ends there).

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is allowed; a
page without html has no links; repeated rows are judged alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracet.llm.store import drop, join_small, new_path, written

#: (verdict, rule): the rule's host, and the path that a url's path starts with.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-6
THRESHOLD = 0.5
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*).*$"
_LINK = "(?i)\\shref\\s*=\\s*[\"']?\\s*(?:https?:)?//([^/?#\"'\\s>]+)"


def _small(column: Column) -> Column:
    return F.translate(column, _CAPITALS, _SMALL)


def host_of(url: str = "url") -> Column:
    return _small(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _URL, 1))


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _URL, 2)


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, blame), scaled so that a seed of 1 without links has 1; rounds: the most, if not until ``tolerance``.

    edges: source, target, weight (positive; one row a pair, source and target differ); seeds: host, trust, distrust.
    """
    out = edges.groupBy("source").agg(F.sum("weight").alias("_w"))
    into = edges.groupBy("target").agg(F.sum("weight").alias("_w"))
    along = edges.join(out, "source").select(F.col("source").alias("_from"), F.col("target").alias("_to"), (F.col("weight") / F.col("_w")).alias("_t"), F.lit(0.0).alias("_d"), F.lit(0.0).alias("_b"))
    against = edges.join(into, "target").join(out.withColumnRenamed("_w", "_o"), "source").select(
        F.col("target").alias("_from"), F.col("source").alias("_to"), F.lit(0.0).alias("_t"), (F.col("weight") / F.col("_w")).alias("_d"), (F.col("weight") / F.col("_o")).alias("_b")
    )
    steps = written(along.unionByName(against).groupBy("_from", "_to").agg(*[F.sum(c).alias(c) for c in ("_t", "_d", "_b")]), "steps")
    hosts = steps.select(F.col("_from").alias("host")).distinct()
    seeds = written(seeds.join(hosts, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "seeds")
    rank, old = seeds.withColumn("blame", F.col("distrust")), None
    if steps.isEmpty():
        return rank
    for _ in itertools.count() if rounds is None else range(rounds):
        sent = steps.join(rank, steps["_from"] == rank["host"]).groupBy("_to").agg(F.sum(F.col("_t") * F.col("trust")).alias("_gt"), F.sum(F.col("_d") * F.col("distrust")).alias("_gd"), F.sum(F.col("_b") * F.col("blame")).alias("_gb"))
        base = seeds.select("host", F.col("trust").alias("_st"), F.col("distrust").alias("_sd"))
        new = base.join(sent, base["host"] == sent["_to"], "left").join(rank.withColumnsRenamed({"trust": "_ot", "distrust": "_od", "blame": "_ob"}), "host")
        new = new.select(
            "host", (F.col("_st") + damping * F.coalesce("_gt", F.lit(0.0))).alias("trust"), (F.col("_sd") + damping * F.coalesce("_gd", F.lit(0.0))).alias("distrust"),
            (F.col("_sd") + (1 - F.col("_sd")) * damping * F.coalesce("_gb", F.lit(0.0))).alias("blame"), "_ot", "_od", "_ob",
        )
        path = new_path(edges.sparkSession, "rank")
        new = written(new, "rank", path)
        change = new.agg(F.max(F.greatest(*[F.abs(F.col(a) - F.col(b)) for a, b in (("trust", "_ot"), ("distrust", "_od"), ("blame", "_ob"))]))).first()[0]
        if old:
            drop(edges.sparkSession, old)
        rank, old = new.drop("_ot", "_od", "_ob"), path
        if change <= tolerance:
            break
    return rank


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust and distrust of its host."""
    host, path = host_of(), path_of()
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumns({"rule": rule, "_says": says})
    links = pages.select(host.alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)))).alias("target"))
    links = links.select("source", _small(F.col("target")).alias("target")).filter("source <> '' and source <> target")
    edges = written(links.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight")), "edges")
    seeds = rows.filter("host <> ''").groupBy("host").agg(
        (F.count_if(F.col("_says") == "allow") / F.count("*")).alias("trust"), (F.count_if(F.col("_says") == "block") / F.count("*")).alias("distrust")
    )
    scores = propagated(edges, seeds)
    out = join_small(rows, scores, "host")
    blocked = F.coalesce(F.greatest("distrust", "blame") - F.col("trust") > threshold, F.lit(False))
    verdict = F.coalesce("_says", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
