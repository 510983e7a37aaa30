"""Queries for the rows of the inventory that have no larger query of their own: sorts, labels, guards, small scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracet.functions import measures, scores, text, urls
from veracet.operators import discovery
from veracet.plans.catalog import query
from veracet.sources import tables, views


@query("p02_pruned_projection", "SELECT l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_quantity >= 49")
def p02(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "lineitem").filter("l_quantity >= 49").select("l_partkey", "l_suppkey", "l_shipdate")


@query(
    "p14_market_contradiction",
    "SELECT page_id, page_id % 3 = 1 AS contradicts FROM pages",
)
def p14(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 3
    address = F.concat(F.lit("https://shop.example.com/"), F.when(n == 0, "en-gb").when(n == 1, "us").otherwise("intl"), F.lit("/x"))
    return views.table(spark, d, "pages").select("page_id", urls.contradicts_market(address, ["UK"]).alias("contradicts"))


@query("g07_grouped_by_any_case", "SELECT lower(brand) AS brand, count(*) AS n, min(model_number) AS first_model FROM v_products GROUP BY 1", "v_products")
def g07(spark: SparkSession, d: str) -> DataFrame:
    p = views.products(spark, d).withColumn("brand", F.when(F.col("product_id") % 2 == 0, F.upper("brand")).otherwise(F.col("brand")))
    return p.groupBy(F.lower("brand").alias("brand")).agg(F.count("*").alias("n"), F.min("model_number").alias("first_model"))


@query(
    "g23_search_hits",
    "SELECT host, market, count(*) AS hits, max(length(url)) AS longest, max(page_id % 4) AS evidence FROM (SELECT *, lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host, regexp_extract(url, '^[^:]+://[^/]+/([a-z]{2})/', 1) AS market FROM pages) GROUP BY ALL",
)
def g23(spark: SparkSession, d: str) -> DataFrame:
    level = F.element_at(F.array(F.lit("none"), F.lit("ambiguous"), F.lit("request_hint"), F.lit("explicit")), (F.col("page_id") % 4 + 1).cast("int"))
    g = views.table(spark, d, "pages").groupBy(urls.host("url").alias("host"), F.regexp_extract("url", "^[^:]+://[^/]+/([a-z]{2})/", 1).alias("market"))
    return g.agg(F.count("*").alias("hits"), F.max(F.length("url")).alias("longest"), F.max(text.evidence_strength(level)).alias("evidence"))


@query(
    "g28_source_history",
    "SELECT source_name, count(DISTINCT category) AS runs, count(*) FILTER (status = 'completed') AS accepted, max(enqueued) FILTER (status = 'completed') AS last_accepted FROM v_queue GROUP BY source_name",
    "v_queue",
)
def g28(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("status") == "completed"
    return views.queue(spark, d).groupBy("source_name").agg(F.countDistinct("category").alias("runs"), F.count_if(done).alias("accepted"), F.max(F.when(done, F.col("enqueued"))).alias("last_accepted"))


@query(
    "g29_reason_histogram",
    "SELECT coalesce(last_error, 'none') AS reason, count(*) AS n, round(avg(CASE WHEN attempts > 0 THEN attempts END), 2) AS avg_attempts FROM v_queue GROUP BY 1",
    "v_queue",
)
def g29(spark: SparkSession, d: str) -> DataFrame:
    positive = F.when(F.col("attempts") > 0, F.col("attempts"))
    return views.queue(spark, d).groupBy(F.coalesce("last_error", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg(positive), 2).alias("avg_attempts"))


@query("g34_overall_averages", "SELECT round(avg(evidence), 2) AS avg_evidence, round(avg(n_values), 2) AS avg_values, round(avg(confidence_pct), 2) AS avg_confidence FROM v_canonical", "v_canonical")
def g34(spark: SparkSession, d: str) -> DataFrame:
    return views.canonical(spark, d).agg(*[F.round(F.avg(c), 2).alias(n) for c, n in (("evidence", "avg_evidence"), ("n_values", "avg_values"), ("confidence_pct", "avg_confidence"))])


@query("w01_latest_snapshot", "SELECT source_name, max(day) AS day, arg_max(crawls, day) AS crawls FROM v_snapshots GROUP BY source_name", "v_snapshots")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(views.snapshots(spark, d), ["source_name"], F.desc("day")).select("source_name", "day", "crawls")


@query("w11_queue_rank", "SELECT item_id, row_number() OVER (ORDER BY importance DESC, attempts DESC, enqueued, item_id) AS rank FROM v_queue WHERE status = 'queued'", "v_queue")
def w11(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("importance"), F.desc("attempts"), F.asc("enqueued"), F.asc("item_id")]
    return tables.ranked(views.queue(spark, d).filter("status = 'queued'"), order).select("item_id", "rank")


@query("o03_skip_and_limit", "SELECT item_id, enqueued FROM v_queue ORDER BY enqueued DESC, item_id LIMIT 30 OFFSET 60", "v_queue")
def o03(spark: SparkSession, d: str) -> DataFrame:
    return tables.page(views.queue(spark, d).select("item_id", "enqueued"), 3, 30, F.desc("enqueued"), F.asc("item_id"))


@query("o05_top_scores", "SELECT source_id, count(*) AS claims FROM v_evidence GROUP BY 1 ORDER BY claims DESC, source_id LIMIT 12", "v_evidence")
def o05(spark: SparkSession, d: str) -> DataFrame:
    return views.evidence(spark, d).groupBy("source_id").agg(F.count("*").alias("claims")).orderBy(F.desc("claims"), "source_id").limit(12)


@query(
    "o07_operational_sort",
    "SELECT source_name, rank FROM (SELECT source_name, row_number() OVER (ORDER BY count(*) FILTER (status = 'failed') / count(*) DESC, count(*) DESC, source_name) AS rank FROM v_logs GROUP BY source_name) WHERE rank <= 25",
    "v_logs",
)
def o07(spark: SparkSession, d: str) -> DataFrame:
    g = views.logs(spark, d).groupBy("source_name").agg((F.count_if(F.col("status") == "failed") / F.count("*")).alias("f"), F.count("*").alias("n"))
    order = [F.desc("f"), F.desc("n"), "source_name"]
    return g.orderBy(*order).limit(25).select("source_name", F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query("o08_conflict_sort", "SELECT product_id, attribute, n_values FROM v_canonical WHERE has_conflict ORDER BY n_values DESC, last_observed DESC, product_id, attribute LIMIT 50", "v_canonical")
def o08(spark: SparkSession, d: str) -> DataFrame:
    c = views.canonical(spark, d).filter("has_conflict").orderBy(F.desc("n_values"), F.desc("last_observed"), "product_id", "attribute")
    return c.limit(50).select("product_id", "attribute", "n_values")


@query(
    "o16_claim_order",
    "SELECT product_id, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY confidence_pct DESC, observed DESC, source_id) AS sources FROM v_evidence WHERE attribute = 'tax' GROUP BY product_id",
    "v_evidence",
)
def o16(spark: SparkSession, d: str) -> DataFrame:
    e = views.evidence(spark, d).filter("attribute = 'tax'")
    claims = F.array_sort(F.collect_list(F.struct((-F.col("confidence_pct")).alias("c"), (-F.unix_micros(F.col("observed").cast("timestamp"))).alias("o"), "source_id")))
    return e.groupBy("product_id").agg(claims.alias("s")).select("product_id", F.array_join(F.transform("s", lambda x: x["source_id"].cast("string")), ",").alias("sources"))


@query("u04_overlap", "SELECT source_id, bool_or(category IN ('promo', 'small')) AS overlaps FROM (SELECT DISTINCT l_suppkey AS source_id, category FROM v_lines WHERE l_quantity = 1) GROUP BY source_id", "v_lines")
def u04(spark: SparkSession, d: str) -> DataFrame:
    li = views.table(spark, d, "lineitem").filter("l_quantity = 1").select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("source_id"))
    g = li.join(views.products(spark, d).select("product_id", "category"), "product_id").groupBy("source_id").agg(F.collect_set("category").alias("c"))
    return g.select("source_id", F.arrays_overlap("c", F.array(F.lit("promo"), F.lit("small"))).alias("overlaps"))


@query(
    "f16_slugs",
    "SELECT DISTINCT p_name, replace(lower(p_name), ' ', '-') AS slug, CASE WHEN p_name LIKE '%y' THEN left(p_name, -1) || 'ies' WHEN p_name LIKE '%s' THEN p_name ELSE p_name || 's' END AS plural FROM part",
)
def f16(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "part").select("p_name", text.slug("p_name").alias("slug"), text.plural("p_name").alias("plural")).distinct()


@query("f18_value_lists", "SELECT conv_id, string_agg(DISTINCT lower(role), ',' ORDER BY lower(role)) AS roles FROM conversations GROUP BY conv_id")
def f18(spark: SparkSession, d: str) -> DataFrame:
    g = views.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.lit(" "), F.upper("role"))).alias("r"))
    return g.select("conv_id", F.array_join(text.value_list("r"), ",").alias("roles"))


@query("f19_truncated", "SELECT doc_id, left(text, 40) AS head, length(text) > 4000 AS is_cut FROM documents")
def f19(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", F.left("text", F.lit(40)).alias("head"), (F.length("text") > 4000).alias("is_cut"))


@query(
    "f36_link_kinds",
    "SELECT page_id, page_id % 4 = 0 AS product, page_id % 4 = 1 AS listing, page_id % 4 = 2 AS sitemap FROM pages",
)
def f36(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 4
    at = F.concat(F.lit("https://e.org"), F.when(n == 0, "/Product/9").when(n == 1, "/browse/tv").when(n == 2, "/Sitemap_1.XML").otherwise("/about"))
    p = views.table(spark, d, "pages").withColumn("at", at)
    return p.select("page_id", urls.is_product("at").alias("product"), urls.is_listing("at").alias("listing"), urls.is_sitemap("at").alias("sitemap"))


@query(
    "f54_listing_scores",
    "SELECT page_id, round(CASE WHEN page_id % 2 = 0 THEN 0.35 + 0.40 + 0.20 ELSE 0 END, 2) AS score, page_id % 2 = 0 AS is_listing FROM pages",
)
def f54(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 2
    p = views.table(spark, d, "pages").select(
        "page_id", F.concat(F.lit("https://e.org/"), F.when(n == 0, "browse/").otherwise("about/"), F.col("page_id").cast("string")).alias("url"),
        F.when(n == 0, '<a href="/p/1">1</a><a href="/p/2">2</a><a href="/p/3">3</a><a href="?page=2">next</a>').otherwise("<p>text</p>").alias("html"),
    )
    return discovery.listing_score(p, discovery.links(p))


@query(
    "f58_fused_decisions",
    "SELECT p_partkey, CASE WHEN judged IS NULL THEN h ELSE round(least(CASE WHEN differs THEN 69.99 ELSE 100 END, h * 0.6 + judged * 0.4), 2) END AS confidence FROM (SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) AS h, CASE WHEN p_partkey % 3 > 0 THEN 80.0 END AS judged, p_partkey % 5 = 0 AND p_partkey % 3 > 0 AS differs FROM part)",
)
def f58(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    judged = F.when(k % 3 > 0, 80.0)
    value = scores.blended_confidence((F.col("p_size") * 2).cast("double"), judged, (k % 5 == 0) & judged.isNotNull())
    return views.table(spark, d, "part").select("p_partkey", value.alias("confidence"))


@query(
    "f61_unit_conversions",
    "SELECT p_partkey, round(p_size * 25.4, 2) AS inch_mm, round(p_size / 25.4, 2) AS mm_inch, p_size * 1024.0 AS tb_gb, round(p_size * 0.001, 3) AS g_kg, CAST(p_size AS DOUBLE) AS same, CAST(NULL AS DOUBLE) AS none FROM part",
)
def f61(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("p_size").cast("double")
    to = lambda a, b: measures.converted(v, F.lit(a), F.lit(b))
    return views.table(spark, d, "part").select(
        "p_partkey", to("inch", "mm").alias("inch_mm"), to("mm", "inch").alias("mm_inch"), to("tb", "gb").alias("tb_gb"), to("g", "kg").alias("g_kg"), to("hz", "hz").alias("same"), to("kg", "mm").alias("none")
    )


@query("f67_retail_booleans", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS supported FROM orders")
def f67(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") % 3
    said = F.when(n == 0, " Supported ").when(n == 1, "not included").otherwise("maybe")
    return views.table(spark, d, "orders").select("o_orderkey", measures.truth(said, measures.RETAIL_TRUE, measures.RETAIL_FALSE).alias("supported"))


@query(
    "f77_labels",
    "SELECT item_id, CASE WHEN importance >= 0.85 THEN 'complete' WHEN importance >= 0.5 THEN 'partial' ELSE 'sparse' END AS completeness, CASE WHEN importance * 100 >= 85 THEN 'Healthy' WHEN importance * 100 >= 70 THEN 'Watch' ELSE 'Attention' END AS health FROM v_queue",
    "v_queue",
)
def f77(spark: SparkSession, d: str) -> DataFrame:
    p = scores.to_percent(F.col("importance"))
    return views.queue(spark, d).select("item_id", scores.completeness_label(F.col("importance")).alias("completeness"), scores.health(p, p, F.lit(70), F.lit(10), strict=True).alias("health"))


@query(
    "f82_eta",
    "SELECT category, round(count(*) FILTER (status <> 'completed') * 60.0 / count(*) FILTER (status = 'completed'), 4) AS minutes_left FROM v_queue GROUP BY category",
    "v_queue",
)
def f82(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return views.queue(spark, d).groupBy("category").agg(F.round((F.count("*") - done) * 60.0 / done, 4).alias("minutes_left"))


@query(
    "t06_discovery_lifecycle",
    "SELECT item_id, CASE WHEN status = 'completed' THEN 'completed' WHEN last_error IS NOT NULL AND attempts >= 3 THEN 'rejected' WHEN last_error IS NOT NULL THEN 'queued' ELSE status END AS state FROM v_queue",
    "v_queue",
)
def t06(spark: SparkSession, d: str) -> DataFrame:
    from veracet.streaming.jobs import next_status

    state = next_status(F.col("status"), F.col("last_error").isNotNull(), F.col("attempts"), 3)
    return views.queue(spark, d).select("item_id", F.when(state == "failed", "rejected").otherwise(state).alias("state"))


@query("t13_retention", "SELECT log_id, ts < TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR AS archived FROM v_logs", "v_logs")
def t13(spark: SparkSession, d: str) -> DataFrame:
    cutoff = F.lit("2024-01-20").cast("timestamp") - F.expr("interval 24 hours")
    return views.logs(spark, d).select("log_id", (F.col("ts") < cutoff).alias("archived"))


def _product_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the table with a trail, a related product and an advert put in; some trails lead to a product."""
    p = views.table(spark, d, "pages").select("page_id", (F.col("page_id") % 3).cast("int").alias("depth"), F.concat(F.lit("https://shop.example/product/"), F.col("page_id").cast("string")).alias("url"))
    body = F.format_string(
        '<nav class="top breadcrumb"><a href="/c/%2$d">c</a><a href="/">home</a><a href="/product/%2$d">p</a></nav><p><a href="/product/%3$d">next</a><a href="/about">about</a></p>',
        F.col("page_id"), F.col("page_id") % 5, F.col("page_id") + 1,
    )
    return p.withColumn("html", body)


@query(
    "t16_related_links",
    "SELECT link, kind, min(depth) AS depth, arg_min(page_id, (depth, page_id)) AS found_on FROM (SELECT page_id, page_id % 3 + 1 AS depth, unnest([{'link': 'https://shop.example/c/' || (page_id % 5), 'kind': 'listing'}, {'link': 'https://shop.example/', 'kind': 'listing'},"
    " {'link': 'https://shop.example/product/' || (page_id % 5), 'kind': 'product'}, {'link': 'https://shop.example/product/' || (page_id + 1), 'kind': 'product'}], recursive := true) FROM pages WHERE page_id % 3 < 2)"
    " WHERE link <> 'https://shop.example/product/' || page_id AND link NOT IN (SELECT 'https://shop.example/product/' || page_id FROM pages WHERE page_id % 2 = 0) GROUP BY link, kind",
)
def t16(spark: SparkSession, d: str) -> DataFrame:
    p = _product_pages(spark, d)
    return discovery.related_links(p, p.filter("page_id % 2 = 0").select(F.col("url").alias("link")), 2)


@query(
    "f52_breadcrumb_links",
    "SELECT page_id, unnest(['https://shop.example/c/' || (page_id % 5), 'https://shop.example/']) AS link FROM pages",
)
def f52(spark: SparkSession, d: str) -> DataFrame:
    return discovery.breadcrumb_links(_product_pages(spark, d)).select("page_id", "link")


@query(
    "f55_page_evidence",
    "SELECT page_id, regexp_matches(html, '(specifications|technical details|key features|product details)', 'i') OR regexp_matches(html, '<(table|dl|th|td)\\b', 'i') OR len(regexp_extract_all(html, 'weight|memory|storage|processor|resolution', 0, 'i')) >= 2 AS technical,"
    " page_id % 4 = 0 AS structured FROM (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN '<dl>' WHEN 1 THEN 'Weight and MEMORY' ELSE 'a weight' END AS html FROM pages)",
)
def f55(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id") % 3
    p = views.table(spark, d, "pages").withColumn("html", F.concat("html", F.when(n == 0, "<dl>").when(n == 1, "Weight and MEMORY").otherwise("a weight")))
    marked = F.when(F.col("page_id") % 4 == 0, "{'@type': 'Product'}").otherwise("{'@type': 'Story'}")
    return p.select("page_id", discovery.technical_evidence("html").alias("technical"), discovery.structured_evidence(F.concat("html", marked)).alias("structured"))


@query(
    "m22_probe_scores",
    "SELECT user_id, 30.0 + CASE WHEN c > 0 THEN 20 ELSE 0 END + CASE WHEN e > 0 THEN 20 ELSE 0 END + CASE WHEN p > 0 THEN 15 ELSE 0 END + CASE WHEN s > 0 THEN 15 ELSE 0 END AS crawlability, least(100.0, 15.0 * (user_id % 4) + least(55.0, 12.0 * p)) AS relevance,"
    " CASE WHEN user_id % 3 = 0 THEN greatest(0.0, x - 35) WHEN user_id % 3 = 1 AND (e > 0 OR s > 0) THEN least(100.0, x + 10) ELSE x END AS extractability, least(100.0, greatest(0.0, 50.0 + 6.0 * (c + CASE WHEN p > 0 THEN 3 ELSE 0 END) - 7.0 * e)) AS likelihood"
    " FROM (SELECT *, CASE WHEN c > 0 THEN 10.0 ELSE 0 END + CASE WHEN p > 0 THEN 55 ELSE 0 END + CASE WHEN e > 0 THEN 20 ELSE 0 END + CASE WHEN s > 0 THEN 15 ELSE 0 END AS x FROM"
    " (SELECT user_id, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'signup') AS s FROM events GROUP BY user_id))",
)
def m22(spark: SparkSession, d: str) -> DataFrame:
    """Users as probed sources: what they have of each kind of event stands for what a probe has found."""
    g = views.table(spark, d, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "error", "purchase", "signup")])
    click, error, purchase, signup = (F.col(k) for k in ("click", "error", "purchase", "signup"))
    n = F.col("user_id") % 3
    return g.select(
        "user_id", scores.crawlability(F.lit(True), click > 0, error > 0, purchase > 0, signup > 0).alias("crawlability"), scores.category_relevance(F.col("user_id") % 4, purchase).alias("relevance"),
        scores.extractability(click > 0, purchase > 0, error > 0, signup > 0, F.when(n == 0, False).when(n == 1, True)).alias("extractability"),
        scores.catalog_likelihood(click, error, purchase > 0).alias("likelihood"),
    )


@query(
    "m09_disagreement_penalty",
    "SELECT e.source_id, greatest(0, least(1, round(CAST(0.12 * avg(CASE WHEN e.value <> c.value THEN 1.0 ELSE 0.0 END) - 0.04 * avg(CASE WHEN e.source_id = c.winner THEN 1.0 ELSE 0.0 END) AS DECIMAL(28,10)), 4))) AS penalty FROM v_evidence e JOIN v_canonical c USING (product_id, attribute) GROUP BY e.source_id",
    "v_evidence v_canonical",
)
def m09(spark: SparkSession, d: str) -> DataFrame:
    c = views.canonical(spark, d).select("product_id", "attribute", F.col("value").alias("w"), "winner")
    both = views.evidence(spark, d).join(c, ["product_id", "attribute"])
    share = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    g = both.groupBy("source_id").agg(share(F.col("value") != F.col("w")).alias("d"), share(F.col("source_id") == F.col("winner")).alias("w"))
    return g.select("source_id", scores.disagreement_penalty(F.col("d"), F.col("w")).alias("penalty"))


@query("m12_suspicious_values", "SELECT attribute, count(*) FILTER (value = '0') > 0 AS suspicious FROM v_changes GROUP BY attribute", "v_changes")
def m12(spark: SparkSession, d: str) -> DataFrame:
    odd = ~measures.plausible(F.lit("laptop"), F.lit("weight_kg"), F.col("value").try_cast("double"))
    return views.changes(spark, d).groupBy("attribute").agg((F.count_if(odd) > 0).alias("suspicious"))


@query("m19_market_alignment", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN -12 ELSE 0 END + CASE p_partkey % 2 WHEN 0 THEN 4 ELSE -6 END AS alignment FROM part")
def m19(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    market = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    return views.table(spark, d, "part").select("p_partkey", scores.market_alignment(market, k % 2 == 0).alias("alignment"))


@query(
    "m21_guardrails",
    "SELECT item_id, importance >= 0.6 AND attempts <= 2 AND last_error IS NULL AS may_suggest, importance >= 0.8 AND attempts = 0 AND last_error IS NULL AND next_attempt IS NULL AS may_accept FROM v_queue",
    "v_queue",
)
def m21(spark: SparkSession, d: str) -> DataFrame:
    clean = F.col("last_error").isNull()
    suggest = F.forall(F.array(F.col("importance") >= 0.6, F.col("attempts") <= 2, clean), lambda x: x)
    accept = F.forall(F.array(F.col("importance") >= 0.8, F.col("attempts") == 0, clean, F.col("next_attempt").isNull()), lambda x: x)
    return views.queue(spark, d).select("item_id", suggest.alias("may_suggest"), accept.alias("may_accept"))


@query("m26_badges", "SELECT entity, attribute, CASE WHEN n >= 5 THEN 'Drifting' WHEN n >= 2 THEN 'Watch' ELSE 'Stable' END AS badge FROM (SELECT entity, attribute, count(*) AS n FROM v_changes GROUP BY ALL)", "v_changes")
def m26(spark: SparkSession, d: str) -> DataFrame:
    return views.changes(spark, d).groupBy("entity", "attribute").agg(scores.drift_badge(F.count("*")).alias("badge"))
