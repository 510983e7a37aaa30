"""Discovery of sources: links of pages, candidates of one site, duplicates, traversal by depth."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracet.functions import urls
from veracet.functions.text import name_key
from veracet.sources.tables import settled

_HREF = "(?is)<(?:a|link)\\b[^>]*?\\bhref\\s*=\\s*[\"']([^\"']*)[\"']"


def links(pages: DataFrame) -> DataFrame:
    """The distinct links of each page in order of appearance: page_id, url, position, link, kind.

    kind: product, pagination, category or related, the first that fits; links to the page itself are dropped.
    """
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), F.lit(1))).alias("position", "href"))
    found = found.withColumn("link", urls.normalise(urls.resolved("href", "url"))).filter(F.col("link").isNotNull() & (F.col("link") != urls.normalise("url")))
    first = Window.partitionBy("page_id", "link").orderBy("position")
    found = found.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    low = F.lower("link")
    kind = (
        F.when(urls.is_product("link"), "product").when(low.rlike("[?&](page|p|offset)=|/page/"), "pagination").when(urls.is_listing("link"), "category").otherwise("related")
    )
    return found.select("page_id", "url", "position", "link", kind.alias("kind"))


_TRAIL = "(?is)<(?:nav|ol|ul|div)\\b[^>]*\\b(?:class|aria-label)\\s*=\\s*[\"'][^\"']*breadcrumb.*?</(?:nav|ol|ul|div)>"


def breadcrumb_links(pages: DataFrame) -> DataFrame:
    """page_id, url, link: the distinct links of a page's breadcrumb trails, but for products."""
    trails = F.array_join(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_TRAIL), F.lit(0)), " ")
    found = links(pages.withColumn("html", trails))
    return found.filter("kind <> 'product'").select("page_id", "url", "link")


def related_links(pages: DataFrame, known: DataFrame, most_depth: int) -> DataFrame:
    """What the pages of products add to the frontier: link, kind (product or listing), least depth and the page it was found on.

    pages: page_id, url, html, depth; known: link, the addresses that the frontier has.  A page's product links, its
    categories and its breadcrumbs are one deeper than it; those beyond ``most_depth`` are left out.
    """
    found = links(pages).filter("kind in ('product', 'category')").select("page_id", "link", F.when(F.col("kind") == "product", "product").otherwise("listing").alias("kind"))
    found = found.unionByName(breadcrumb_links(pages).select("page_id", "link", F.lit("listing").alias("kind")))
    deeper = pages.select("page_id", (F.col("depth") + 1).alias("depth")).filter(F.col("depth") <= most_depth)
    best = F.min(F.struct("depth", "page_id")).alias("b")
    out = found.join(deeper, "page_id").groupBy("link").agg(best, F.max("kind").alias("kind"))  # a product by either is one
    return out.join(known.select("link"), "link", "left_anti").select("link", "kind", F.col("b.depth").alias("depth"), F.col("b.page_id").alias("found_on"))


def structured_evidence(html: F.Column | str, products: F.Column | None = None) -> F.Column:
    """Whether a page describes a product to machines; products: how many were extracted from it, if that is known."""
    h = F.lower(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")))
    said = h.contains("application/ld+json") & h.contains("product") | h.rlike("[\"']@type[\"']\\s*:\\s*[\"']product[\"']") | h.contains("schema.org/product")
    return said if products is None else said | F.coalesce(products > 0, F.lit(False))


def technical_evidence(html: F.Column | str) -> F.Column:
    """Whether a page lists technical properties: a heading for them, a table, or two words for such properties."""
    h = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    # The words that count.
    heading = h.rlike("(?i)specifications|technical details|key features|product details")
    words = F.size(F.regexp_extract_all(h, F.lit("(?i)(screen size|resolution|hdmi|refresh rate|panel type|processor|memory|storage|weight|dimensions|bluetooth|wifi)"), F.lit(1)))
    return heading | h.rlike("(?i)<(table|dl|th|td)\\b") | (words >= 2)


def product_pages(pages: DataFrame, classify=None) -> DataFrame:
    """page_id, answer and confidence of a classifier of pages; classify: a function of (url, html) columns that returns the answer
    yes, no or null (it can't tell), such as a pandas UDF around a model.  Without one the score by rules answers.

    A model's answer has confidence 0.8 if yes and 0.2 if no; no answer is neutral, 0.5.
    """
    if classify is None:
        answer = F.when(product_score("url", "html") >= 0.60, "yes").otherwise("no")
    else:
        answer = F.lower(F.trim(classify(F.col("url"), F.col("html"))))
    confidence = F.when(F.col("answer") == "yes", 0.8).when(F.col("answer") == "no", 0.2).otherwise(0.5)
    return pages.select("page_id", answer.alias("answer")).withColumn("confidence", confidence)


def product_score(url: F.Column | str, html: F.Column | str) -> F.Column:
    """How much a page looks like a product's: address, metadata, commerce words and prices."""
    h = F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit(""))
    # The patterns that count.
    meta = h.rlike("(?i)og:type[\"'=\\s:>]+product|itemtype=[\"'][^\"']*Product|data-product")
    commerce = h.rlike("(?i)add[- ]to[- ](cart|basket)|buy[- ]now|sku|mpn|gtin|model")
    price = h.rlike("(?i)price|priceCurrency|availability|InStock|Offer")
    parts = [(urls.is_product(url), 0.45), (meta, 0.30), (commerce, 0.20), (price, 0.15)]
    total = F.lit(0.0)
    for test, weight in parts:
        total = total + F.when(test, weight).otherwise(0.0)
    return F.round(total, 2)


def listing_score(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, score, is_listing from the page's links and markers."""
    n = found.groupBy("page_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("product", "pagination", "category")])
    rows = pages.select("page_id", "url", "html").join(n, "page_id", "left").fillna(0, ["product", "pagination", "category"])
    marker = F.coalesce("html", F.lit("")).rlike("(?i)pagination|product-grid|product-list|category-title|filters|sort-by|results")
    score = (
        F.when(urls.is_listing("url"), 0.35).otherwise(0.0) + F.when(F.col("product") >= 3, 0.40).when(F.col("product") >= 1, 0.20).otherwise(0.0)
        + F.when(F.col("pagination") > 0, 0.20).otherwise(0.0) + F.when(F.col("category") > 0, 0.15).otherwise(0.0) + F.when(marker, 0.15).otherwise(0.0)
    )
    return rows.select("page_id", F.round(score, 2).alias("score")).withColumn("is_listing", F.col("score") >= 0.45)


def collapsed(candidates: DataFrame) -> DataFrame:
    """candidates: key, name, url, market, reasons (array), score.  One row per key: the best row's fields, and all rows'
    markets and reasons."""
    best = F.max(F.struct(F.col("score"), (-F.length("name")).alias("short"), F.col("url"), F.col("name")))
    out = candidates.groupBy("key").agg(
        best.alias("b"), F.count("*").alias("candidates"), F.array_sort(F.collect_set("market")).alias("markets"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons")
    )
    return out.select("key", F.col("b.name").alias("name"), F.col("b.url").alias("url"), F.col("b.score").alias("score"), "candidates", "markets", "reasons")


def potential_duplicates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) that may be one source: equal host, equal base address, or equal name with a shared market.

    Both: id, host, base, name, markets (array).  Each way is an equi-join; their union is made distinct.
    """
    x = a.select(F.col("id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in ("host", "base", "name", "markets")])
    y = b.select(F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("host", "base", "name", "markets")])
    shared = F.arrays_overlap("a_markets", "b_markets") | (F.size("a_markets") == 0) | (F.size("b_markets") == 0)
    ways = [
        x.join(y, F.col("a_host") == F.col("b_host")),
        x.join(y, F.col("a_base") == F.col("b_base")),
        x.join(y, (name_key("a_name") == name_key("b_name")) & shared),
    ]
    out = ways[0].select("a_id", "b_id")
    for w in ways[1:]:
        out = out.unionByName(w.select("a_id", "b_id"))
    return out.distinct()


def duplicate_classes(rows: DataFrame, ways: dict[str, list]) -> DataFrame:
    """(way, representative, id) for the members of each class of at least two ids that agree in all columns of a way.

    Two ids are a pair if they share a (way, representative); the representative, the smallest id, is a member too.  So
    a class of n ids is n rows and not n * (n - 1).  Null keys and ids agree with none; repeated rows count once.
    """
    each = F.array(*[F.struct(F.lit(w).alias("way"), F.array(*[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]).alias("key")) for w, cols in ways.items()])
    keyed = rows.filter("id is not null").select("id", F.explode(each).alias("_e")).select("id", "_e.way", "_e.key").filter(~F.exists("key", F.isnull)).distinct()
    classes = keyed.groupBy("way", "key").agg(F.min("id").alias("representative"), F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(classes, ["way", "key"]).select("way", "representative", "id")


def pair_count(rows: DataFrame, ways: dict[str, list]) -> DataFrame:
    """One row, ``pairs``: ordered pairs of ids that agree in some way, by inclusion and exclusion of the classes' sizes, so none is made.

    An id has one row (or equal ones).
    """
    keys = {w: F.array(*[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]) for w, cols in ways.items()}
    keyed = rows.filter("id is not null").select("id", *[F.when(~F.exists(k, F.isnull), k).alias(w) for w, k in keys.items()]).distinct()
    found = []
    for n in range(1, len(ways) + 1):
        for some in itertools.combinations(ways, n):
            size = keyed.dropna(subset=list(some)).groupBy(*some).agg(F.count("*").alias("n"))
            found.append(size.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("n")).select((F.col("n") * (-1) ** (n + 1)).alias("n")))
    return functools.reduce(DataFrame.unionByName, found).agg(F.sum("n").alias("pairs"))


def reached(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Breadth-first: node and the least depth at which links reach it from the seeds; edges: source, target; seeds: node.

    One join and one anti-join for each depth; each front is checkpointed, so that none is computed anew for the next.
    """
    front = found = settled(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        following = front.join(edges, front["node"] == edges["source"]).select(F.col("target").alias("node")).distinct()
        front = settled(following.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def frontier(urls_seen: DataFrame) -> DataFrame:
    """urls_seen: source, category, url, depth, state, ts, parent.  One row per address: least depth, first and last seen, latest state."""
    keyed = urls_seen.withColumn("key", urls.normalise("url"))
    return keyed.groupBy("source", "category", "key").agg(
        F.min("depth").alias("depth"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("state", F.struct("ts", "state")).alias("state"),
        F.min_by("parent", F.struct("ts", "parent")).alias("parent"), F.count("*").alias("seen"),
    )
