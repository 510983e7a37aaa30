"""Queries over the source, filter, sort and set operators (S, P, O, U) on the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracet.functions import scores, text, urls
from veracet.plans.catalog import query
from veracet.sources import tables, views

AS_OF = "2024-01-31 00:00:00"


def _as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


@query("s01_scan_filtered", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size >= 40")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return tables.scan(spark, f"{d}/part.parquet", "p_partkey bigint, p_brand string, p_size int").filter("p_size >= 40")


@query("s02_point_lookup", "SELECT * FROM v_products WHERE product_id = 42", "v_products")
def s02(spark: SparkSession, d: str) -> DataFrame:
    return tables.lookup(views.products(spark, d), product_id=42)


@query("s03_compound_lookup", "SELECT * FROM v_products WHERE brand = 'Brand#2' AND model_number = 'small ring'", "v_products")
def s03(spark: SparkSession, d: str) -> DataFrame:
    return tables.lookup(views.products(spark, d), brand="Brand#2", model_number="small ring", gtin=None)


@query("s04_latest_by_key", "SELECT source_name, url, log_id, status, ts FROM v_logs QUALIFY row_number() OVER (PARTITION BY source_name, url ORDER BY ts DESC, log_id) = 1", "v_logs")
def s04(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(views.logs(spark, d), ["source_name", "url"], F.desc("ts"), F.asc("log_id")).select("source_name", "url", "log_id", "status", "ts")


@query("s05_append", "SELECT source_name, count(*) AS logs, CAST(sum(duration_ms) AS BIGINT) AS ms FROM v_logs GROUP BY source_name", "v_logs")
def s05(spark: SparkSession, d: str) -> DataFrame:
    logs = views.logs(spark, d)
    old, new = logs.filter("log_id % 2 = 0"), logs.filter("log_id % 2 = 1")
    return old.unionByName(new).groupBy("source_name").agg(F.count("*").alias("logs"), F.sum("duration_ms").alias("ms"))


@query(
    "s06_upsert",
    "SELECT item_id, status, attempts FROM v_queue WHERE status <> 'queued' UNION ALL SELECT item_id, 'processing', attempts + 1 FROM v_queue WHERE status = 'queued'",
    "v_queue",
)
def s06(spark: SparkSession, d: str) -> DataFrame:
    q = views.queue(spark, d).select("item_id", "status", "attempts")
    changes = q.filter("status = 'queued'").withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "_seq": F.lit(1)})
    stale = changes.withColumns({"status": F.lit("lost"), "_seq": F.lit(0)})
    return tables.upserted(q, changes.unionByName(stale), ["item_id"])


@query(
    "s07_compare_and_set",
    "SELECT item_id, attempts % 2 = 0 AS applied, CASE WHEN attempts % 2 = 0 THEN attempts + 1 ELSE attempts END AS revision_after FROM v_queue",
    "v_queue",
)
def s07(spark: SparkSession, d: str) -> DataFrame:
    q = views.queue(spark, d).select("item_id", F.col("attempts").alias("revision"))
    wanted = q.withColumn("revision", F.when(F.col("revision") % 2 == 0, F.col("revision")).otherwise(F.col("revision") + 1))
    after, judged = tables.compare_and_set(q, wanted, ["item_id"])
    return judged.select("item_id", "applied").join(after.withColumnRenamed("revision", "revision_after"), "item_id")


@query(
    "s08_atomic_claim",
    f"SELECT item_id, 'processing' AS status, attempts + 1 AS attempts, CAST('{AS_OF}' AS TIMESTAMP) AS last_attempt FROM v_queue"
    f" WHERE status = 'queued' AND (next_attempt IS NULL OR next_attempt <= CAST('{AS_OF}' AS TIMESTAMP))",
    "v_queue",
)
def s08(spark: SparkSession, d: str) -> DataFrame:
    return tables.claimed(views.queue(spark, d), _as_of()).select("item_id", "status", "attempts", "last_attempt")


@query("s09_delete", "SELECT item_id FROM v_queue WHERE status <> 'completed'", "v_queue")
def s09(spark: SparkSession, d: str) -> DataFrame:
    q = views.queue(spark, d)
    return tables.deleted(q, q.filter("status = 'completed'").select("item_id"), ["item_id"]).select("item_id")


@query("s10_count_by_scope", "SELECT category, count(*) FILTER (status IN ('queued', 'processing')) AS active FROM v_queue GROUP BY category", "v_queue")
def s10(spark: SparkSession, d: str) -> DataFrame:
    return views.queue(spark, d).groupBy("category").agg(F.count_if(F.col("status").isin("queued", "processing")).alias("active"))


@query("s11_exists", "SELECT source_name FROM v_sources s WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = source_id AND l_quantity >= 50)", "v_sources")
def s11(spark: SparkSession, d: str) -> DataFrame:
    big = views.table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_suppkey").alias("source_id"))
    return views.sources(spark, d).join(big, "source_id", "left_semi").select("source_name")


@query(
    "s14_sitemap_urls",
    "SELECT page_id, url AS loc FROM pages UNION SELECT page_id, 'https://example.org/' || page_id FROM pages",
)
def s14(spark: SparkSession, d: str) -> DataFrame:
    page = views.table(spark, d, "pages").select("page_id", F.replace("url", F.lit("&"), F.lit("&")).alias("u"))
    xml = F.concat(F.lit("<urlset xmlns='s'><url><loc> "), F.col("u"), F.lit(" </loc></url><url><loc>https://example.org/"), F.col("page_id").cast("string"), F.lit("</loc></url><url><loc>"), F.col("u"), F.lit("</loc></url></urlset>"))
    return tables.sitemaps(page.withColumn("xml", xml), "xml").select("page_id", F.explode("urls").alias("loc"))


@query(
    "s15_sitemap_locations",
    "SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, regexp_extract(url, '^(https?://[^/?#]+)', 1) || s AS location FROM pages, (VALUES ('/map.xml'), ('/sitemap.xml'), ('/sitemap_index.xml')) t(s)",
)
def s15(spark: SparkSession, d: str) -> DataFrame:
    site = views.table(spark, d, "pages").select(F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("site")).distinct()
    robots = F.array(F.concat(F.col("site"), F.lit("/map.xml")), F.concat(F.col("site"), F.lit("/sitemap.xml")))
    hints = F.array(F.lit("not an address"))
    return site.select("site", F.explode(tables.sitemap_locations(F.col("site"), robots, hints)).alias("location"))


@query(
    "s17_csv_rows",
    "SELECT page_id, CASE WHEN regexp_matches(url, '[\",\\r\\n]') THEN '\"' || replace(url, '\"', '\"\"') || '\"' ELSE url END"
    " || ',\"' || replace('say \"' || page_id || '\", then', '\"', '\"\"') || '\"' AS line FROM pages",
)
def s17(spark: SparkSession, d: str) -> DataFrame:
    note = F.concat(F.lit('say "'), F.col("page_id").cast("string"), F.lit('", then'))
    return views.table(spark, d, "pages").select("page_id", F.concat_ws(",", tables.csv_field(F.col("url")), tables.csv_field(note)).alias("line"))


@query(
    "s18_export_source_quality",
    "SELECT source_name AS \"Source\", market AS \"Market\", CASE WHEN enabled THEN 'yes' ELSE 'no' END AS \"Enabled\" FROM v_sources",
    "v_sources",
)
def s18(spark: SparkSession, d: str) -> DataFrame:
    return views.sources(spark, d).select(F.col("source_name").alias("Source"), F.col("market").alias("Market"), F.when(F.col("enabled"), "yes").otherwise("no").alias("Enabled"))


@query(
    "s20_telemetry",
    "SELECT status, least(CAST(floor(duration_ms / 100) AS BIGINT), 10) AS bucket, count(*) AS n FROM v_logs GROUP BY ALL",
    "v_logs",
)
def s20(spark: SparkSession, d: str) -> DataFrame:
    return views.logs(spark, d).groupBy("status", F.least(F.floor(F.col("duration_ms") / 100), F.lit(10)).alias("bucket")).agg(F.count("*").alias("n"))


@query("p01_projection", "SELECT product_id, brand || ' / ' || model_number AS name, coalesce(gtin, '-') AS gtin_shown FROM v_products", "v_products")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return views.products(spark, d).select("product_id", F.concat_ws(" / ", "brand", "model_number").alias("name"), text.shown("gtin").alias("gtin_shown"))


@query("p03_optional_filters", "SELECT product_id FROM v_products WHERE category = 'economy' AND (size = 11 OR size IN (12, 13))", "v_products")
def p03(spark: SparkSession, d: str) -> DataFrame:
    return tables.lookup(views.products(spark, d), category="economy", brand=None).filter((F.col("size") == 11) | F.col("size").isin(12, 13)).select("product_id")


@query("p04_text_search", "SELECT product_id FROM v_products WHERE regexp_matches(lower(title), 'ring|gear') OR gtin = '42'", "v_products")
def p04(spark: SparkSession, d: str) -> DataFrame:
    return views.products(spark, d).filter(F.col("title").rlike("(?i)RING|gear") | (F.col("gtin") == "42")).select("product_id")


@query(
    "p05_array_filters",
    "SELECT l_suppkey AS source_id FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey HAVING bool_or(p_type = 'PROMO') AND bool_or(p_type IN ('SMALL', 'LARGE'))",
)
def p05(spark: SparkSession, d: str) -> DataFrame:
    kinds = views.claims(spark, d).groupBy("source_id").agg(F.collect_set("category").alias("kinds"))
    return kinds.filter(F.array_contains("kinds", "promo") & F.arrays_overlap("kinds", F.array(F.lit("small"), F.lit("large")))).select("source_id")


@query("p06_trailing_day", f"SELECT log_id FROM v_logs WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR", "v_logs")
def p06(spark: SparkSession, d: str) -> DataFrame:
    return views.logs(spark, d).filter(F.col("ts") >= _as_of() - F.expr("interval 24 hours")).select("log_id")


@query("p07_due_items", "SELECT item_id FROM v_queue WHERE status = 'queued' AND (next_attempt IS NULL OR next_attempt <= TIMESTAMP '1997-01-01')", "v_queue")
def p07(spark: SparkSession, d: str) -> DataFrame:
    return tables.claimed(views.queue(spark, d), F.lit("1997-01-01").cast("timestamp")).select("item_id")


@query(
    "p08_product_facets",
    "SELECT product_id, attribute, CASE WHEN has_conflict THEN 'with_conflicts' ELSE 'no_conflicts' END AS conflict_status FROM v_canonical WHERE evidence >= 20 AND has_conflict AND attribute = 'returnflag'",
    "v_canonical",
)
def p08(spark: SparkSession, d: str) -> DataFrame:
    c = views.canonical(spark, d).withColumn("conflict_status", F.when(F.col("has_conflict"), "with_conflicts").otherwise("no_conflicts"))
    wanted = text.category_key(F.lit("With-Conflicts"))
    return c.filter((F.col("evidence") >= 20) & (F.col("conflict_status") == wanted) & (F.col("attribute") == "returnflag")).select("product_id", "attribute", "conflict_status")


@query("p09_state_filter", "SELECT item_id, status FROM v_queue WHERE status IN ('queued', 'processing')", "v_queue")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return views.queue(spark, d).filter(F.col("status").isin("queued", "processing")).select("item_id", "status")


@query(
    "p10_domain_rules",
    "SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)), '(^|\\.)example\\.(net|org)$') AS allowed FROM pages",
)
def p10(spark: SparkSession, d: str) -> DataFrame:
    allowed = urls.host_in("url", ["example.net", "example.org"]) & ~urls.is_private(urls.host("url"))
    return views.table(spark, d, "pages").select("page_id", allowed.alias("allowed"))


@query(
    "p11_request_validation",
    "SELECT category, count(*) AS targets, count(*) <= 500 AS within_limit, count(*) > 100 AS needs_sources FROM v_queue GROUP BY category",
    "v_queue",
)
def p11(spark: SparkSession, d: str) -> DataFrame:
    n = views.queue(spark, d).groupBy("category").agg(F.count("*").alias("targets"))
    return n.withColumns({"within_limit": F.col("targets") <= 500, "needs_sources": F.col("targets") > 100})


_HOST = "lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1))"
_PATH = "lower(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1))"


@query(
    "p12_link_policy",
    f"SELECT page_id, CASE WHEN page_id % 5 > 3 OR NOT regexp_matches({_HOST}, '(^|\\.)example\\.(com|org)$') THEN false WHEN {_PATH} LIKE '/de%' THEN false WHEN {_PATH} LIKE '/en%' THEN true"
    " WHEN contains(lower(url), '/fr/') THEN true ELSE false END AS allowed FROM pages",
)
def p12(spark: SparkSession, d: str) -> DataFrame:
    allowed = urls.link_allowed("url", (F.col("page_id") % 5).cast("int"), ["example.com", "example.org"], 3, ("/de",), (), ("/en",), None, ("/fr/",), ())
    return views.table(spark, d, "pages").select("page_id", allowed.alias("allowed"))


@query(
    "p13_robots",
    f"SELECT page_id, CASE WHEN {_PATH} LIKE '/en/1%' THEN {_PATH} NOT LIKE '/en/10%' WHEN {_PATH} LIKE '/fr%' THEN true ELSE false END AS blocked FROM pages",
)
def p13(spark: SparkSession, d: str) -> DataFrame:
    robots = "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow: /en/1 # old\nAllow: /en/10\nDisallow: /fr\nDisallow:\n"
    rows = views.table(spark, d, "pages").withColumn("rules", tables.robots_rules(F.lit(robots)))
    return rows.select("page_id", tables.robots_blocks(F.col("rules"), urls.path("url")).alias("blocked"))


@query(
    "p15_blank",
    "SELECT count(*) FILTER (trim(coalesce(gtin, '')) = '') AS blank, count(*) FILTER (trim(coalesce(gtin, '')) <> '') AS filled FROM v_products",
    "v_products",
)
def p15(spark: SparkSession, d: str) -> DataFrame:
    return views.products(spark, d).agg(F.count_if(text.is_blank("gtin")).alias("blank"), F.count_if(~text.is_blank("gtin")).alias("filled"))


_STATES = ["queued", "running", "paused", "cancel_requested", "recoverable", "cancelled", "completed", "failed"]
_CANDIDATES = ["pending", "probing", "awaiting_llm", "suggested", "auto_accepted", "manually_accepted", "dismissed", "archived", "superseded", "failed"]


@query(
    "p16_state_guards",
    f"SELECT item_id, s IN ('queued', 'running') AS pause, s = 'paused' AS resume, s IN ('queued', 'paused') AS stop_at_once, s = 'running' AS request_stop, s IN ('cancelled', 'completed', 'failed') AS terminal, s NOT IN ('cancelled', 'completed', 'failed') AS active,"
    " c = 'suggested' AS accept, c IN ('suggested', 'failed', 'archived') AS dismiss, c IN ('dismissed', 'archived') AS restore, c IN ('pending', 'probing', 'awaiting_llm') AS progress, c IN ('pending', 'probing', 'awaiting_llm', 'suggested', 'auto_accepted') AS supersede"
    f" FROM (SELECT item_id, ({_STATES})[item_id % 8 + 1] AS s, ({_CANDIDATES})[item_id % 10 + 1] AS c FROM v_queue)",
    "v_queue",
)
def p16(spark: SparkSession, d: str) -> DataFrame:
    """Each queue item in turn as a run and as a candidate in one of their states, of any case."""
    run = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("item_id") % 8 + 1).cast("int"))
    candidate = F.initcap(F.element_at(F.array(*map(F.lit, _CANDIDATES)), (F.col("item_id") % 10 + 1).cast("int")))
    of_run = [scores.may(run, a).alias(a) for a in scores.RUN_STATES]
    return views.queue(spark, d).select("item_id", *of_run, *[scores.may(candidate, a, scores.CANDIDATE_STATES).alias(a) for a in scores.CANDIDATE_STATES])


@query(
    "t17_run_transitions",
    "SELECT item_id, CASE WHEN a = 'pause' AND s IN ('queued', 'running') THEN 'paused' WHEN a = 'resume' AND s = 'paused' THEN 'queued' WHEN a = 'stop' AND s IN ('queued', 'paused') THEN 'cancelled' WHEN a = 'stop' AND s = 'running' THEN 'cancel_requested' ELSE s END AS after"
    f" FROM (SELECT item_id, ({_STATES})[item_id % 8 + 1] AS s, (['pause', 'resume', 'stop', 'other'])[(item_id // 8) % 4 + 1] AS a FROM v_queue)",
    "v_queue",
)
def t17(spark: SparkSession, d: str) -> DataFrame:
    run = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("item_id") % 8 + 1).cast("int"))
    action = F.element_at(F.array(*map(F.lit, ("pause", "resume", "stop", "other"))), F.expr("int(item_id div 8 % 4 + 1)"))
    return views.queue(spark, d).select("item_id", scores.run_after(run, action).alias("after"))


@query("p17_archive_eligible", "SELECT item_id FROM v_queue WHERE status = 'completed' AND coalesce(next_attempt, enqueued) <= TIMESTAMP '1996-06-01'", "v_queue")
def p17(spark: SparkSession, d: str) -> DataFrame:
    when = F.coalesce("next_attempt", "enqueued")
    return views.queue(spark, d).filter((F.col("status") == "completed") & (when <= F.lit("1996-06-01").cast("timestamp"))).select("item_id")


@query(
    "p18_eligible_sources",
    "SELECT source_id FROM v_sources WHERE enabled AND EXISTS (SELECT 1 FROM v_lines WHERE l_suppkey = source_id AND category IN ('promo', 'large'))",
    "v_sources v_lines",
)
def p18(spark: SparkSession, d: str) -> DataFrame:
    kinds = views.claims(spark, d).groupBy("source_id").agg(F.collect_set("category").alias("kinds"))
    wanted = F.array(F.lit("promo"), F.lit("large"))
    return views.sources(spark, d).filter("enabled").join(kinds, "source_id").filter(F.arrays_overlap("kinds", wanted)).select("source_id")


@query(
    "o01_product_sorts",
    "SELECT product_id, attribute, row_number() OVER (ORDER BY last_observed, product_id, attribute) AS stalest, row_number() OVER (ORDER BY n_values DESC, product_id, attribute) AS most_conflicts FROM v_canonical WHERE attribute = 'tax'",
    "v_canonical",
)
def o01(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    c = views.canonical(spark, d).filter("attribute = 'tax'")
    stalest = F.row_number().over(W.orderBy("last_observed", "product_id", "attribute"))
    return c.select("product_id", "attribute", stalest.alias("stalest"), F.row_number().over(W.orderBy(F.desc("n_values"), "product_id", "attribute")).alias("most_conflicts"))


@query("o02_page", "SELECT product_id, model_number FROM v_products ORDER BY model_number, product_id LIMIT 25 OFFSET 50", "v_products")
def o02(spark: SparkSession, d: str) -> DataFrame:
    return tables.page(views.products(spark, d).select("product_id", "model_number"), 3, 25, F.asc("model_number"), F.asc("product_id"))


@query(
    "o04_review_order",
    "SELECT item_id, status, importance FROM v_queue ORDER BY CASE status WHEN 'processing' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, importance DESC, enqueued, item_id LIMIT 40",
    "v_queue",
)
def o04(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("status") == "processing", 0).when(F.col("status") == "queued", 1).otherwise(2)
    return views.queue(spark, d).orderBy(rank, F.desc("importance"), "enqueued", "item_id").limit(40).select("item_id", "status", "importance")


@query("o11_newest_logs", "SELECT log_id, ts FROM v_logs ORDER BY ts DESC, log_id LIMIT 100", "v_logs")
def o11(spark: SparkSession, d: str) -> DataFrame:
    return views.logs(spark, d).orderBy(F.desc("ts"), "log_id").limit(100).select("log_id", "ts")


@query("o12_oldest_due", "SELECT item_id, next_attempt FROM v_queue WHERE status = 'queued' AND next_attempt IS NOT NULL ORDER BY next_attempt, item_id LIMIT 20", "v_queue")
def o12(spark: SparkSession, d: str) -> DataFrame:
    due = views.queue(spark, d).filter("status = 'queued' and next_attempt is not null")
    return due.orderBy("next_attempt", "item_id").limit(20).select("item_id", "next_attempt")


@query(
    "o14_ordered_reasons",
    "SELECT item_id, string_agg(r, '; ' ORDER BY w DESC, r) AS reasons FROM (SELECT item_id, 'attempts' AS r, attempts AS w FROM v_queue UNION ALL SELECT item_id, 'importance', CAST(round(importance * 5) AS INTEGER) FROM v_queue) GROUP BY item_id",
    "v_queue",
)
def o14(spark: SparkSession, d: str) -> DataFrame:
    reasons = F.array(F.struct((-F.col("attempts")).alias("w"), F.lit("attempts").alias("r")), F.struct((-F.round(F.col("importance") * 5).cast("int")).alias("w"), F.lit("importance").alias("r")))
    return views.queue(spark, d).select("item_id", F.array_join(F.transform(F.array_sort(reasons), lambda x: x["r"]), "; ").alias("reasons"))


@query(
    "o15_timeline",
    "SELECT * FROM (SELECT 'log' AS kind, CAST(log_id AS VARCHAR) AS id, ts AS moment FROM v_logs UNION ALL SELECT 'enqueued', CAST(item_id AS VARCHAR), enqueued FROM v_queue) ORDER BY moment DESC, kind, id LIMIT 60",
    "v_logs v_queue",
)
def o15(spark: SparkSession, d: str) -> DataFrame:
    a = views.logs(spark, d).select(F.lit("log").alias("kind"), F.col("log_id").cast("string").alias("id"), F.col("ts").alias("moment"))
    b = views.queue(spark, d).select(F.lit("enqueued").alias("kind"), F.col("item_id").cast("string").alias("id"), F.col("enqueued").alias("moment"))
    return a.unionByName(b).orderBy(F.desc("moment"), "kind", "id").limit(60)


@query("u01_union_distinct", "SELECT DISTINCT lower(n) AS name FROM (SELECT n_name AS n FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer)")
def u01(spark: SparkSession, d: str) -> DataFrame:
    names = [views.table(spark, d, t).select(F.lower(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"))]
    return names[0].unionByName(names[1]).unionByName(names[2]).distinct()


@query(
    "u02_key_union",
    "SELECT product_id, max(value) FILTER (attribute = 'tax' AND evidence > 15) AS tax, max(value) FILTER (attribute = 'returnflag' AND evidence < 30) AS flag FROM v_canonical"
    " WHERE (attribute = 'tax' AND evidence > 15) OR (attribute = 'returnflag' AND evidence < 30) GROUP BY product_id",
    "v_canonical",
)
def u02(spark: SparkSession, d: str) -> DataFrame:
    c = views.canonical(spark, d)
    a = c.filter("attribute = 'tax' and evidence > 15").select("product_id", F.col("value").alias("tax"))
    b = c.filter("attribute = 'returnflag' and evidence < 30").select("product_id", F.col("value").alias("flag"))
    return a.join(b, "product_id", "full")


@query(
    "u03_jaccard",
    ", m AS (SELECT DISTINCT brand, model_number, list_distinct(string_split(lower(model_number), ' ')) AS t FROM v_products) SELECT a.brand, a.model_number AS a_model, b.model_number AS b_model, round(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t)), 4) AS score"
    " FROM m a JOIN m b ON a.brand = b.brand AND a.model_number < b.model_number AND len(list_intersect(a.t, b.t)) > 0",
    "v_products",
)
def u03(spark: SparkSession, d: str) -> DataFrame:
    """The different model numbers of a brand that share a token, not all pairs of its products."""
    m = views.products(spark, d).select("brand", "model_number").distinct().withColumn("t", text.tokens("model_number"))
    a = m.select("brand", F.col("model_number").alias("a_model"), F.col("t").alias("ta"), F.explode("t").alias("token"))
    b = m.select("brand", F.col("model_number").alias("b_model"), F.col("t").alias("tb"), F.explode("t").alias("token"))
    pairs = a.join(b, ["brand", "token"]).filter("a_model < b_model").dropDuplicates(["brand", "a_model", "b_model"])
    return pairs.select("brand", "a_model", "b_model", text.jaccard(F.col("ta"), F.col("tb")).alias("score"))


@query(
    "u05_evaluation_keys",
    "SELECT category, string_agg(attribute, ',' ORDER BY attribute) AS keys FROM (SELECT DISTINCT category FROM v_products), v_definitions WHERE required OR sensitivity IN ('critical', 'high') GROUP BY category",
    "v_products v_definitions",
)
def u05(spark: SparkSession, d: str) -> DataFrame:
    defs = views.definitions(spark)
    keys = defs.filter("required").select("attribute").union(defs.filter("sensitivity in ('critical', 'high')").select("attribute")).distinct()
    keys = keys.agg(F.array_join(F.array_sort(F.collect_list("attribute")), ",").alias("keys"))
    return views.products(spark, d).select("category").distinct().crossJoin(F.broadcast(keys))


@query(
    "u06_sequence_equality",
    "SELECT user_id, list(event_type ORDER BY ts) = list(event_type ORDER BY ts DESC) AS palindrome, list(event_type ORDER BY ts) = list(event_type ORDER BY value, event_id) AS same FROM events GROUP BY user_id",
)
def u06(spark: SparkSession, d: str) -> DataFrame:
    g = views.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_type"))).alias("s"), F.array_sort(F.collect_list(F.struct("value", "event_id", "event_type"))).alias("v"))
    kinds, by_value = F.transform("s", lambda x: x["event_type"]), F.transform("v", lambda x: x["event_type"])
    return g.select("user_id", kinds.eqNullSafe(F.reverse(kinds)).alias("palindrome"), kinds.eqNullSafe(by_value).alias("same"))


@query(
    "u07_search_queries",
    "SELECT DISTINCT q FROM (SELECT category || ' ' || brand AS q FROM (SELECT DISTINCT category FROM v_products), (SELECT DISTINCT brand FROM v_products) UNION ALL SELECT 'buy ' || category FROM v_products"
    " UNION ALL SELECT category || ' specifications' FROM v_products UNION ALL SELECT brand || ' official site' FROM v_products)",
    "v_products",
)
def u07(spark: SparkSession, d: str) -> DataFrame:
    p = views.products(spark, d)
    cats, brands = p.select("category").distinct(), p.select("brand").distinct()
    both = cats.crossJoin(F.broadcast(brands)).select(F.concat_ws(" ", "category", "brand").alias("q"))
    more = cats.select(F.explode(F.array(F.concat(F.lit("buy "), F.col("category")), F.concat(F.col("category"), F.lit(" specifications")))).alias("q"))
    return both.unionByName(more).unionByName(brands.select(F.concat(F.col("brand"), F.lit(" official site")).alias("q"))).distinct()


@query("u08_minus", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def u08(spark: SparkSession, d: str) -> DataFrame:
    o = views.table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return views.table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")
